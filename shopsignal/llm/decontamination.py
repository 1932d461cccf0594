"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's word windows, grouped by length m. A shift table over blocks of two
words gives, for the block that ends at a position, how far the search may jump: blocks that no
pattern holds jump m - 1 words. Where the shift is 0, the bucket of that suffix block and of the
prefix block m words before selects the patterns, and word-by-word comparison confirms them.
All documents of a step are searched side by side, one lane each, so a jump is one numpy operation.
"""
from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import append_columns, as_bytes, fresh_names, kept, materialize, shuffle_partitions
from shopsignal.llm.mixing import prefix_sums

#: bytes other than 0-9, a-z (A-Z lower-cased) and those from 0x80 separate words
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LANE_WORDS = 1024
SHARD_WORDS = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _ranks(ids: np.ndarray, m: int) -> np.ndarray:
    """A number for the run of ``m`` ids at each place, equal for equal runs (places too close to the end get none): by doubling, each step numbers pairs."""
    rank, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while size < m:
        step = min(size, m - size)          # two runs that overlap cover a length that is no power of two
        rank = np.unique((rank[:-step] << 32) | rank[step:], return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


class WuManber:
    """Search tables of all runs of ``m`` words in some items; memory is about a hundred bytes a word while it is built, forty after.

    ``ids`` are the items' word ids one after the other, item k in ``first[k]:first[k] + sizes[k]``, none shorter than m.
    """

    def __init__(self, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, m: int):
        self.ids, self.m, self.block = ids.astype(np.int32), m, min(2, m)
        b = self.block
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(ids)) - np.repeat(first, sizes)
        # the block that ends at an item's word j ends a pattern if j >= m - 1, else it comes m - 1 - j words before the first pattern's end
        ends = np.flatnonzero(place >= b - 1)
        codes, shifts = self._at(self.ids, ends), np.maximum(0, m - 1 - place[ends])
        order = np.lexsort((shifts, codes))
        codes, shifts = codes[order], shifts[order]
        least = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.codes, self.shifts = codes[least], shifts[least].astype(np.int16)
        del ends, codes, shifts, order, least
        # distinct patterns: where one starts, and whose it is
        starts = np.flatnonzero(place + m <= sizes[item])
        rank = _ranks(ids, m)[starts]
        owner = item[starts]
        order = np.lexsort((owner, rank))
        rank, owner, starts = rank[order], owner[order], starts[order]
        fresh = np.r_[True, rank[1:] != rank[:-1]]
        once = fresh | np.r_[True, owner[1:] != owner[:-1]]
        self.starts = starts[fresh]
        self.owners = owner[once]
        self.owner_ends = np.cumsum(np.bincount((np.cumsum(fresh) - 1)[once], minlength=len(self.starts)))
        # buckets: patterns sorted by the pair of their last and first block
        self.suffixes, last = np.unique(self._at(self.ids, self.starts + m - 1), return_inverse=True)
        self.prefixes, head = np.unique(self._at(self.ids, self.starts + b - 1), return_inverse=True)
        pair = last.astype(np.int64) * len(self.prefixes) + head
        self.bucket = np.argsort(pair, kind="stable").astype(np.int32)
        self.pairs = pair[self.bucket]

    def items_of(self, pattern: int) -> np.ndarray:
        return self.owners[self.owner_ends[pattern - 1] if pattern else 0:self.owner_ends[pattern]]

    def _at(self, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
        last = ids[pos].astype(np.int64)
        return last if self.block == 1 else (ids[pos - 1].astype(np.int64) << 32) | last

    def search(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, start) of every occurrence inside one of the ranges lo:hi of ``ids``.

        Ids below 1 stand for words that no pattern holds.
        """
        m, b = self.m, self.block
        pos = lo + m - 1
        found_p, found_s = [], []
        live = pos < hi
        pos, end = pos[live], hi[live]
        while len(pos):
            code = self._at(ids, pos)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            shift = np.where(self.codes[at] == code, self.shifts[at], m - b + 1)
            zero = pos[shift == 0]
            if len(zero):
                p, s = self._confirm(ids, zero)
                found_p.append(p)
                found_s.append(s)
            pos = pos + np.maximum(shift, 1)
            live = pos < end
            pos, end = pos[live], end[live]
        empty = np.empty(0, np.int64)
        return (np.concatenate(found_p), np.concatenate(found_s)) if found_p else (empty, empty)

    def _confirm(self, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = pos - self.m + 1
        place = []
        for table, code in ((self.suffixes, self._at(ids, pos)), (self.prefixes, self._at(ids, start + self.block - 1))):
            at = np.minimum(np.searchsorted(table, code), len(table) - 1)
            place.append((at, table[at] == code))
        start = start[place[0][1] & place[1][1]]
        pair = (place[0][0].astype(np.int64) * len(self.prefixes) + place[1][0])[place[0][1] & place[1][1]]
        a, z = np.searchsorted(self.pairs, pair, "left"), np.searchsorted(self.pairs, pair, "right")
        out_p, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while True:                                      # one candidate of each position at a time
            live = a < z
            a, z, start = a[live], z[live], start[live]
            if not len(a):
                return np.concatenate(out_p), np.concatenate(out_s)
            who = self.bucket[a]
            match = (ids[start[:, None] + np.arange(self.m)] == self.ids[self.starts[who][:, None] + np.arange(self.m)]).all(axis=1)
            out_p.append(who[match].astype(np.int64))
            out_s.append(start[match])
            a = a + 1


class Searcher:
    """All windows of a set of benchmark items: ``items`` holds (item id, words)."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids, sizes, names = array("i"), [], []
        for item, words in items:
            if words:
                ids.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                sizes.append(len(words))
                names.append(item)
        flat, sizes = np.frombuffer(ids, np.int32) if sizes else np.empty(0, np.int32), np.array(sizes, np.int64)
        first = np.cumsum(sizes) - sizes
        self.classes = []
        for m in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == m)
            part = flat[np.repeat(first[own], sizes[own]) + np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])]
            self.classes.append((WuManber(part, np.cumsum(sizes[own]) - sizes[own], sizes[own], m), [names[k] for k in own]))

    def search(self, texts: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Word counts of the texts, where each ends in their sequence, and per class the occurrences (pattern, start)."""
        words, lengths = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = words_of(text)
            lengths[i] = len(own)
            words += own
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        del words
        ends = np.cumsum(lengths)
        found = []
        for wm, owners in self.classes:
            lanes = np.maximum(1, -(-lengths // LANE_WORDS))     # long documents get several lanes
            doc = np.repeat(np.arange(len(texts)), lanes)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            lo = (ends - lengths)[doc] + nth * LANE_WORDS
            hi = np.minimum(lo + LANE_WORDS + wm.m - 1, ends[doc])
            p, s = wm.search(ids, lo, hi)
            found.append((p, s, wm, owners))
        return lengths, ends, found


def _cut(batches, window: int, most: int):
    """(item, words, text) of the items: words joined by blanks, an item of over ``most`` words in pieces that share window - 1 words."""
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_of(text)
            step = max(1, most - window + 1)
            for a in range(0, max(1, len(words) - window + 1), step):
                piece = words[a:a + step + window - 1]
                if piece:
                    out.append((item, len(piece), b" ".join(piece)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], names=["item", "n", "words"])


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = 13, share: int = 20, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what the benchmark's word windows hit in each text; and the new columns' names.

    New columns (renamed if they clash, see the dict): n_words, n_hit (words inside any occurrence),
    hits (array of word positions, start and end in turn, of the maximal hit intervals), items
    (array of the ids, as strings, of items with an occurrence), contaminated (n_hit > 0 and
    share * n_hit >= n_words). An item of fewer words than the window is one window; null and empty
    texts have no words and no hits; items with null id or no words take no part; rows repeated in
    either table change nothing; empty tables give no rows or no hits.

    The benchmark is sent to the tasks only in shards of ``shard_words`` words (the last piece of a shard may pass
    it once more), by running sums of the items' words; larger items are cut, so that the search tables of a worker
    stay below about 100 bytes * 2 * ``shard_words``, plus their vocabulary. Several shards take several passes over the
    documents, written between passes.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")) \
        .filter("item is not null and text is not null").distinct()
    pieces = materialize(bench.mapInArrow(lambda b: _cut(b, window, shard_words), "item string, n long, words binary"), "benchmark")
    size = pieces.agg(F.sum("n")).first()[0] or 0
    if size > shard_words:
        order = ["item", "words"]
        pieces = materialize(prefix_sums(pieces, order, "n", "before", max(1, min(shuffle_partitions(spark), size // shard_words)))
                             .withColumn("shard", F.floor(F.col("before") / shard_words)), "benchmark")
        shards = pieces.agg(F.max("shard")).first()[0] + 1
    else:
        pieces, shards = pieces.withColumn("shard", F.lit(0)), 1
    names = fresh_names(docs.columns, ("n_words", "n_hit", "hits", "items", "contaminated"))
    n_words, n_hit, hits, items, bad = names.values()
    new_n, new_h, new_i = fresh_names([*docs.columns, *names.values()], ("_n", "_h", "_i")).values()
    out, columns = docs, docs.columns
    for k in range(shards):
        rows = pieces.filter(F.col("shard") == k).select("item", "words").collect()                 # about shard_words at most
        sent = spark.sparkContext.broadcast([(r.item, bytes(r.words)) for r in rows])
        step = append_columns(out, text, [(new_n, "bigint"), (new_h, "array<int>"), (new_i, "array<string>")], _scorer(sent, uuid.uuid4().hex, window))
        if k == 0:
            out = step.withColumnsRenamed({new_n: n_words, new_h: hits, new_i: items})
        else:
            out = step.withColumn(hits, F.concat(hits, new_h)).withColumn(items, F.array_sort(F.array_union(items, new_i))).drop(new_n, new_h, new_i)
        if shards > 1:
            out = materialize(out, "decontamination")
    if shards > 1:
        out = out.withColumn(hits, _merged(F.col(hits)))
    out = out.withColumn(n_hit, F.expr(f"aggregate(sequence(0, cast(size(`{hits}`) / 2 as int)), 0L, (s, i) -> s + coalesce(get(`{hits}`, 2 * i + 1) - get(`{hits}`, 2 * i), 0))"))
    out = out.withColumn(bad, (F.col(n_hit) > 0) & (F.col(n_hit) * share >= F.col(n_words)))
    return out.select(*columns, *names.values()), names


def _merged(pairs):
    """Intervals given as start and end in turn, of several passes: sorted and merged."""
    spans = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(pairs) / 2).cast("int") - 1), lambda i: F.struct(F.get(pairs, 2 * i).alias("a"), F.get(pairs, 2 * i + 1).alias("b"))))
    flat = F.aggregate(spans, F.array().cast("array<int>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1) >= s["a"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), s["b"])))).otherwise(F.concat(acc, F.array(s["a"], s["b"]))))
    return F.when(F.size(pairs) == 0, pairs).otherwise(flat)


def _scorer(sent, key: str, window: int):
    def score(texts: list) -> list[list]:
        searcher = kept(("searcher", key), lambda: Searcher(((item, words.split(b" ")) for item, words in sent.value), window))
        lengths, ends, found = searcher.search(texts)
        hits, items = [[] for _ in texts], [[] for _ in texts]
        total = int(ends[-1]) if len(ends) else 0
        if any(len(p) for p, *_ in found):
            cover = np.zeros(total + 1, np.int64)
            for p, s, wm, owners in found:
                np.add.at(cover, s, 1)
                np.add.at(cover, s + wm.m, -1)
                doc = np.searchsorted(ends, s, "right")
                pairs = np.unique(np.stack([doc, p]), axis=1) if len(p) else np.empty((2, 0), np.int64)
                for d, k in pairs.T.tolist():
                    items[d] = sorted({*items[d], *(owners[i] for i in wm.items_of(k))})
            inside = np.cumsum(cover[:-1]) > 0
            for d in np.unique(np.concatenate([np.searchsorted(ends, s, "right") for _, s, _, _ in found])).tolist():
                a, z = int(ends[d] - lengths[d]), int(ends[d])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], inside[a:z].view(np.int8), [0]))))
                hits[d] = edge.astype(np.int32)
        return [lengths.tolist(), hits, items]
    return score
