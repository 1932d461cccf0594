"""SimHash near-dedup: fingerprints linked by the generalised pigeonhole principle.

For m parts of the 64 bits and a radius r, two fingerprints within r bits agree, for any integer
thresholds t_1..t_m >= -1 that add up to r - m + 1, within t_i bits in some part i. Correlated bits
go to the same part, and each fingerprint gets its own thresholds by dynamic programming on the
candidate counts estimated from value histograms over all fingerprints; -1 skips a part. Every
fingerprint is stored under its m part values and probes the values within its thresholds; whoever
meets is verified by its full bit distance. Only a spanning forest of each meeting is kept, and
components follow by alternating star contractions.
"""
from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.llm.common import append_columns, fresh_names, materialize, shuffle_partitions

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLICE = 1 << 15                 # shingles whose bits are added up at once
HISTOGRAM_BITS = 16             # a part's histogram has at most 2**16 values
HOT = 20_000                    # stored fingerprints of one value in one meeting
MEETING_ROWS = 100_000


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles; 0 without a word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        part = words[a:a + SLICE + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        k = min(SLICE, n - a)
        h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, k)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, k, 255):                       # sums of up to 255 bits fit a byte
            ones += bits[b:b + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with each text's fingerprint as a signed long column ``name``."""
    def score(texts):
        return [[(f := fingerprint(t, shingle, seed)) - ((f >> 63) << 64) for t in texts]]
    return append_columns(docs, text, [(name, "bigint")], score, keep)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits 0-63 in ``parts`` groups: each takes the free bits that correlate most with its own.

    together[i, j]: fingerprints with both bits set; n: all fingerprints.
    """
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    free, out = list(range(64)), []
    for g in range(parts):
        width = 64 // parts + (g < 64 % parts)
        rest = corr[np.ix_(free, free)] - np.eye(len(free))
        group = [free.pop(int(rest.sum(1).argmax()))]
        while len(group) < width:
            group.append(free.pop(int(corr[np.ix_(free, group)].sum(1).argmax())))
        out.append(sorted(group))
    return out


def part_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def balls(width: int, radius: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, .. radius set bits among ``width``."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], np.uint64) for t in range(radius + 1)]


def estimates(values: np.ndarray, width: int, histogram: np.ndarray, radius: int) -> np.ndarray:
    """Estimated work of a threshold -1, 0, .. radius per fingerprint: probes plus candidates.

    The histogram counts the low 16 bits of the part's value over all fingerprints; the other
    bits count as even.
    """
    low = min(width, HISTOGRAM_BITS)
    key = (values & np.uint64((1 << low) - 1)).astype(np.int64)
    out = np.zeros((len(values), radius + 2))
    near = [sum(histogram[key ^ int(m)] for m in masks) for masks in balls(low, radius)]
    for t in range(radius + 1):
        probes = math.comb(width, t)
        met = sum(near[j] * math.comb(width - low, t - j) for j in range(t + 1) if t - j <= width - low) / 2.0 ** (width - low)
        out[:, t + 1] = out[:, t] + probes + met
    return out


def allocate(costs: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds per fingerprint and part (>= -1, adding up to ``total``) of the least summed cost."""
    m, n, top = len(costs), len(costs[0]), costs[0].shape[1] - 2
    span = total + m                                         # thresholds plus one add up to this
    best = np.full((n, span + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for c in costs:
        new, pick = np.full((n, span + 1), np.inf), np.zeros((n, span + 1), np.int8)
        for s in range(span + 1):
            for t in range(min(top + 1, s) + 1):
                cost = best[:, s - t] + c[:, t]
                better = cost < new[:, s]
                new[better, s], pick[better, s] = cost[better], t
        best = new
        picks.append(pick)
    out, left, rows = np.zeros((n, m), np.int64), np.full(n, span), np.arange(n)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][rows, left] - 1
        left = left - out[:, i] - 1
    return out


def choose_parts(n: int, radius: int) -> int:
    """The number of parts with the least expected rows and candidates for n even fingerprints."""
    def cost(m):
        t = radius - m + 1                                   # (t, 0, .., 0) after m - 1 zero thresholds
        width = 64 / m
        probes = sum(math.comb(int(width), j) for j in range(t + 1)) + (m - 1)
        return n * (m + probes) + n * probes * n / 2 ** width
    return min(range(2, radius + 2), key=cost) if radius else 1


def link_fingerprints(nodes: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``radius`` bits: a spanning forest of the links.

    ``nodes`` has a long column ``fp`` without repeats. Fingerprints are never gathered: the driver
    gets the 64 x 64 bit counts and the parts' histograms, of at most 2**16 values each.
    """
    spark = nodes.sparkSession
    counts = nodes.mapInArrow(_bit_counts, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together = np.zeros((64, 64))
    for r in counts.collect():                               # at most 64 * 65 / 2 rows
        together[r.i, r.j] = together[r.j, r.i] = r.n
    n = nodes.count()
    parts = parts or choose_parts(n, radius)
    groups = group_bits(together, n, parts)

    def values(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, bits in enumerate(groups):
                low = part_value(fps, bits[:HISTOGRAM_BITS])
                v, c = np.unique(low, return_counts=True)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(v), p, np.int32)), "value": v.astype(np.int64), "n": c.astype(np.int64)})
    rows = nodes.select("fp").mapInArrow(values, "part int, value bigint, n bigint") \
        .groupBy("part", "value").agg(F.sum("n").alias("n")).collect()   # at most parts * 2**16 rows
    tables = [np.zeros(1 << min(len(g), HISTOGRAM_BITS), np.int64) for g in groups]
    for r in rows:
        tables[r.part][r.value] = r.n
    sent = spark.sparkContext.broadcast(tables)
    meetings = max(4 * shuffle_partitions(spark), -(-n * 3 * parts // MEETING_ROWS))

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fps), 4096):
                yield from _deal(fps[a:a + 4096], groups, sent.value, radius, meetings)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return _meet(rows, radius)

    dealt = nodes.select("fp").mapInArrow(deal, "meeting int, code bigint, fp bigint, stored boolean")
    return dealt.groupBy("meeting").applyInPandas(meet, "a bigint, b bigint").distinct()


def _bit_counts(batches):
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for a in range(0, len(fps), 1 << 16):
            bits = ((fps[a:a + (1 << 16), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)        # sums of at most 2**16 are exact
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[i, j]})


def _deal(fps, groups, tables, radius, meetings):
    """Rows of one batch: each fingerprint under its part values, and its probes.

    A value with more than HOT fingerprints is split by a hash of the stored one; its probes go to
    every split, so no link is lost.
    """
    vals = [part_value(fps, g) for g in groups]
    total = radius - len(groups) + 1
    top = max(1, -(-total // len(groups)), min(2, total + len(groups) - 1))
    costs = [estimates(v, len(g), h, top) for v, g, h in zip(vals, groups, tables)]
    thresholds = allocate(costs, total)
    for p, (v, g, h) in enumerate(zip(vals, groups, tables)):
        low = np.uint64(len(h) - 1)
        splits = -(-h // HOT)
        salt = (_mix(fps) % np.maximum(splits[(v & low).astype(np.int64)], 1).astype(np.uint64))
        yield _rows(p, v, salt, fps, True, meetings)
        for t, masks in enumerate(balls(len(g), max(int(thresholds[:, p].max()), 0))):
            at = np.flatnonzero(thresholds[:, p] >= t)
            for k in range(0, len(at), max(1, (1 << 18) // len(masks))):
                own = at[k:k + max(1, (1 << 18) // len(masks))]
                probe = (v[own, None] ^ masks[None, :]).ravel()
                who = np.repeat(fps[own], len(masks))
                n = splits[(probe & low).astype(np.int64)]
                keep = n > 0                                  # no fingerprint has such a value
                probe, who, n = probe[keep], who[keep], n[keep]
                copies = np.repeat(np.arange(len(n)), n)
                part = np.arange(len(copies)) - np.repeat(np.cumsum(n) - n, n)
                yield _rows(p, probe[copies], part.astype(np.uint64), who[copies], False, meetings)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rows(part, value, salt, fps, stored, meetings):
    code = _mix((value << np.uint64(2)) + np.uint64(part) + _mix(salt + np.uint64(1)))
    return pa.RecordBatch.from_pydict({
        "meeting": (code % np.uint64(meetings)).astype(np.int32), "code": code.view(np.int64),
        "fp": np.ascontiguousarray(fps).view(np.int64), "stored": pa.array(np.full(len(fps), stored))})


def _meet(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Verify probes against the stored fingerprints of their code; return a spanning forest."""
    code, fp, stored = rows["code"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["stored"].to_numpy(bool)
    order = np.argsort(code[stored], kind="stable")
    have, held = code[stored][order], fp[stored][order]
    ask, who = code[~stored], fp[~stored]
    lo, hi = np.searchsorted(have, ask, "left"), np.searchsorted(have, ask, "right")
    forest: dict[int, int] = {}

    def root(x):
        while (up := forest.get(x, x)) != x:
            forest[x] = x = forest.get(up, up)
        return x

    done = 0
    sizes = np.cumsum(hi - lo)
    while done < len(ask):                                    # about 2**20 comparisons at once
        base = sizes[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(sizes, base + (1 << 20), "right")))
        n = (hi - lo)[done:end]
        left = np.repeat(who[done:end], n)
        at = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[done:end], n)
        right = held[at]
        near = np.flatnonzero((np.bitwise_count(left ^ right) <= radius) & (left != right))
        for a, b in zip(left[near].tolist(), right[near].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                forest[max(ra, rb)] = min(ra, rb)
        done = end
    pairs = [(x, root(x)) for x in list(forest)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.uint64).reshape(-1, 2)
    return pd.DataFrame({"a": np.ascontiguousarray(pairs[:, 0]).view(np.int64), "b": np.ascontiguousarray(pairs[:, 1]).view(np.int64)})


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b): root is the least node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        new = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new, "edges")
        same = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() == edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def roots(prints: DataFrame, fp: str, radius: int = 3) -> DataFrame:
    """``(fp, root)`` for the fingerprints that are linked to another one."""
    nodes = materialize(prints.select(F.col(fp).alias("fp")).distinct(), "fingerprints")
    return connected(link_fingerprints(nodes, radius)).select(F.col("node").alias("fp"), "root")


def classes(prints: DataFrame, fp: str, doc_id: str, radius: int) -> DataFrame:
    """``(fp, root, least)`` for every fingerprint: its class and the class's smallest doc_id."""
    nodes = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("own")) \
        .join(roots(prints, fp, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("own").alias("least"))
    return nodes.join(least, "root")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Class of every document: ``doc_id``, ``fingerprint`` (long), ``component_id``.

    Fingerprints within ``radius`` bits are linked; component_id is the smallest doc_id reachable.
    Null, empty and blank texts have the fingerprint 0, which links like any other; equal texts,
    and repeated rows, share a fingerprint; a null doc_id stays null and is the smallest only where
    no other is (component_id null); an empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = materialize(with_fingerprint(base, "text", "fp", shingle, keep=["doc_id"]), "prints")
    return prints.join(classes(prints, "fp", "doc_id", radius), "fp") \
        .select("doc_id", F.col("fp").alias("fingerprint"), F.col("least").alias("component_id"))


def first_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each near-duplicate class, one row a class.

    Cases as in ``near_duplicates``; of rows that share that doc_id the first by fingerprint, text
    and the other columns stays. The columns are those of ``docs``.
    """
    names = fresh_names(docs.columns, ("_fp", "_key", "_rank"))
    fp, key, rank = names["_fp"], names["_key"], names["_rank"]

    def with_key(column):
        return F.concat(F.when(column.isNull(), "-").otherwise("+"), F.coalesce(column.cast("string"), F.lit("")))
    prints = materialize(with_fingerprint(docs, text, fp, shingle), "printed")
    firsts = classes(prints, fp, doc_id, radius).filter(F.col("own").eqNullSafe(F.col("least"))) \
        .groupBy("root").agg(F.min(F.struct("least", "fp")).alias("f")) \
        .select(F.col("f.fp").alias(fp), with_key(F.col("f.least")).alias(key))
    rows = prints.withColumn(key, with_key(F.col(doc_id))).join(firsts, [fp, key])
    window = Window.partitionBy(fp, key).orderBy(*[c for c, t in docs.dtypes if "map<" not in t and t != "variant"])
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).select(*docs.columns)
