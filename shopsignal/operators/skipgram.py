"""Item vectors by skip-gram with negative samples (as in the original), trained without holding the vocabulary in one place.

Words are dealt to blocks by a hash. A block's input and output vectors are one row each, and the pairs of an item and its
neighbours are packed by (input block, output block). A round trains as many cells as there are blocks, no two of which share a
block: cell (i, i + round). After it the input blocks stay and the output blocks move on by one. An epoch is a round for each
block; then every pair has been used once. A task holds two blocks and the pairs of one cell, the driver nothing but counts.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.operators.numeric import materialize, shared_folder, sized

BLOCK_WORDS = 500_000      # words of a block at most, on average
CELL_PAIRS = 4_000_000     # pairs of a cell at most, on average
SPREAD_WORDS = 2_500       # smaller vocabularies have a block for so many words,
SPREAD_BLOCKS = 12         # but no more than these
ROUNDS_A_JOB = 24          # rounds between two writes of the vectors
SLICE_ITEMS = 500_000      # items whose pairs a task makes at once
STEP_PAIRS = 2_048         # pairs whose gradients are taken at the same vectors, at most
LEAST_STEP = 32            # ... and no more than a block has words, or these: the same words' gradients would add up
STEP_REPEATS = 8           # a word's gradients of one step count for so many pairs at most
NEGATIVES = 5
RATES = (0.025, 0.0001)    # first and last learning rate

_STATE = "place int, kind int, block int, data binary"    # kind 0: input vectors, 1: output vectors, 2: pairs
_VECTOR = "block int, idx int, embedding array<double>"


def word_blocks(words: int, items: int, window: int) -> int:
    pairs = 2 * window * items
    return max(1, -(-words // BLOCK_WORDS), math.ceil(math.sqrt(pairs / CELL_PAIRS)) if words > SPREAD_WORDS else 1,
               min(-(-words // SPREAD_WORDS), SPREAD_BLOCKS))


def number_words(counts: DataFrame, item_col: str, blocks: int) -> DataFrame:
    """(item, _n, block, idx): words by hash block, numbered in each in their order."""
    dealt = counts.withColumn("block", F.pmod(F.xxhash64(item_col), F.lit(blocks)).cast("int"))
    return dealt.withColumn("idx", F.row_number().over(Window.partitionBy("block").orderBy(item_col)) - 1)


def packed_pairs(word_lists: DataFrame, blocks: int, window: int) -> DataFrame:
    """(place, data, round): the pairs of each list's words up to ``window`` apart, in both directions, as packed 64-bit
    numbers (input word, output word, distance). ``items`` are longs, block * 2^32 + idx."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [np.asarray(v, dtype=np.int64) for v in pdf["items"]]
            ends = np.cumsum([len(v) for v in lists])
            start = 0
            while start < len(lists):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_ITEMS, side="right")))
                yield from cells(lists[start:stop])
                start = stop

    def cells(lists: list) -> Iterator[pd.DataFrame]:
        words = np.concatenate(lists)
        of = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        block, idx = words >> 32, words & 0xFFFFFFFF
        cell, packed = [], []
        for d in range(1, window + 1):
            left = np.flatnonzero(of[:-d] == of[d:])
            for a, b in ((left, left + d), (left + d, left)):
                cell.append(block[a] * blocks + block[b])
                packed.append(idx[a] << 34 | idx[b] << 4 | d)
        cell, packed = np.concatenate(cell), np.concatenate(packed)
        order = np.argsort(cell, kind="stable")
        cell, packed = cell[order], packed[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        for s, e in zip(first, [*first[1:], len(cell)]):
            i, j = divmod(int(cell[s]), blocks)
            yield pd.DataFrame({"place": [i], "data": [packed[s:e].tobytes()], "round": [(j - i) % blocks]})
    return word_lists.select("items").mapInPandas(pack, "place int, data binary, round int")


def add_rows(m: np.ndarray, idx: np.ndarray, delta: np.ndarray) -> None:
    """Add each row of ``delta`` to the row of ``m`` that ``idx`` names; of more than STEP_REPEATS the mean counts that often."""
    order = np.argsort(idx, kind="stable")
    of = idx[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    times = np.diff(np.r_[first, len(of)])
    if times.max() > STEP_REPEATS:
        total = np.add.reduceat(delta[order], first, axis=0)
    else:                            # the same sums, faster: the rows' first gradients, then their second, ...
        total = delta[order[first]]
        for r in range(1, times.max()):
            more = np.flatnonzero(times > r)
            total[more] += delta[order[first[more] + r]]
    m[of[first]] += total * np.minimum(1, STEP_REPEATS / times).astype(np.float32)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train_cell(vin: np.ndarray, out: np.ndarray, pairs: np.ndarray, window: int, rate: float, rng) -> None:
    """Train ``vin`` and ``out`` (its last column: the words' weights as negative samples) on packed ``pairs`` in place. Each
    item sees the nearest 1 to ``window`` neighbours on either side, so a pair d apart is used (window + 1 - d) / window times."""
    pairs = np.sort(pairs)
    pairs = pairs[rng.random(len(pairs)) < (window + 1 - (pairs & 15)) / window]
    pairs = rng.permutation(pairs)
    vout, noise = out[:, :-1], np.cumsum(out[:, -1], dtype=np.float64)
    many = min(STEP_PAIRS, max(LEAST_STEP, min(len(vin), len(vout))))
    for s in range(0, len(pairs), many):
        p = pairs[s:s + many]
        a, b = p >> 34, (p >> 4) & ((1 << 30) - 1)
        neg = np.minimum(np.searchsorted(noise, rng.random((len(p), NEGATIVES)) * noise[-1], side="right"), len(noise) - 1)
        to = np.concatenate([b[:, None], neg], axis=1)
        x, y = vin[a], vout[to]
        g = -sigmoid(np.einsum("id,ikd->ik", x, y))
        g[:, 0] += 1
        g[:, 1:][neg == b[:, None]] = 0          # the neighbour itself is no negative sample
        g = (g * rate).astype(np.float32)
        add_rows(vin, a, np.einsum("ik,ikd->id", g, y))
        add_rows(vout, to.ravel(), (g[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1]))


def train(word_lists: DataFrame, numbered: DataFrame, blocks: int, size: int, window: int, epochs: int, seed: int) -> DataFrame:
    """(block, idx, embedding) of the words of ``numbered`` (block, idx, _n); ``word_lists`` as in ``packed_pairs``.

    The result depends on data, seed and number of blocks alone: a cell's pairs are sorted before they are drawn."""
    spark = numbered.sparkSession
    folder = shared_folder(spark, "pairs")
    pairs = packed_pairs(word_lists, blocks, window)
    pairs.write.partitionBy("round").parquet(folder)
    pairs = spark.read.schema(pairs.schema).parquet(folder)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        block, pdf = int(pdf["block"].iloc[0]), pdf.sort_values("idx")
        vin = ((np.random.default_rng([seed, block]).random((len(pdf), size)) - 0.5) / size).astype(np.float32)
        out = np.zeros((len(pdf), size + 1), dtype=np.float32)
        out[:, -1] = pdf["_n"].to_numpy(np.float64) ** 0.75
        return pd.DataFrame({"place": block, "kind": [0, 1], "block": block, "data": [vin.tobytes(), out.tobytes()]})

    def trained(epoch: int, rnd: int):
        rate = RATES[0] + (RATES[1] - RATES[0]) * (epoch * blocks + rnd) / (epochs * blocks)

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = {0: [], 1: [], 2: []}
            for pdf in batches:
                for kind, block, data in zip(pdf["kind"], pdf["block"], pdf["data"]):
                    held[kind].append((block, data))
            vin = [(i, np.frombuffer(d, np.float32).reshape(-1, size).copy()) for i, d in held[0]]
            out = [(j, np.frombuffer(d, np.float32).reshape(-1, size + 1).copy()) for j, d in held[1]]
            if vin and out and held[2]:
                cell = np.concatenate([np.frombuffer(d, np.int64) for _, d in held[2]])
                train_cell(vin[0][1], out[0][1], cell, window, rate, np.random.default_rng([seed, epoch, int(vin[0][0]), int(out[0][0])]))
            for i, m in vin:
                yield pd.DataFrame({"place": [i], "kind": [0], "block": [i], "data": [m.tobytes()]})
            for j, m in out:
                yield pd.DataFrame({"place": [(j - rnd - 1) % blocks], "kind": [1], "block": [j], "data": [m.tobytes()]})
        return step

    state = materialize(numbered.select("block", "idx", "_n").groupBy("block").applyInPandas(start, _STATE), "vectors")
    for n in range(epochs * blocks):
        epoch, rnd = divmod(n, blocks)
        cells = pairs.filter(F.col("round") == rnd).select("place", F.lit(2).alias("kind"), F.col("place").alias("block"), "data")
        state = state.unionByName(cells).repartitionById(blocks, F.col("place")).mapInPandas(trained(epoch, rnd), _STATE)
        if n % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            state = materialize(state, "vectors")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"]):
                m = np.frombuffer(data, np.float32).reshape(-1, size).astype(np.float64)
                for s in range(0, len(m), 10_000):
                    part = m[s:s + 10_000]
                    yield pd.DataFrame({"block": block, "idx": np.arange(s, s + len(part)), "embedding": list(part)})
    return state.filter("kind = 0").mapInPandas(rows, _VECTOR)


def item_vectors(sequences: DataFrame, counts: DataFrame, sentences, item_col: str, size: int, window: int, epochs: int,
                 seed: int) -> DataFrame:
    """(item, embedding) of every word of ``counts`` (item, _n). ``sentences`` makes lists of rows (ClientID, Position, word)."""
    words = counts.agg(F.count(F.lit(1)).alias("w"), F.sum("_n").alias("n")).first()
    blocks = word_blocks(words["w"], words["n"] or 0, window)
    numbered = materialize(number_words(counts, item_col, blocks), "words")
    ids = sized(numbered.select(item_col, F.expr("shiftleft(cast(block as bigint), 32) + idx").alias("word")))
    lists = sentences(sequences.join(ids, item_col).drop(item_col), "word")
    vectors = train(lists, numbered, blocks, size, window, epochs, seed)
    return materialize(numbered.select(item_col, "block", "idx").join(vectors.hint("merge"), ["block", "idx"]).select(item_col, "embedding"), "item-vectors")
