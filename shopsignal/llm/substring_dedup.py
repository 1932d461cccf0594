"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted across the corpus.

Rows are dealt to *blocks* of a few MB by a hash of the whole row (copies of a text spread out).
Each block hashes all its windows with two rolling polynomials and sends every *distinct* hash once,
packed by hash range (*slot*), so a window that a third of all rows hold arrives once per block.
Each slot counts its hashes over all blocks and returns one bit per hash it was sent. Each block
then marks the words under repeated windows, which merge into maximal intervals, and removes them.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import power_of_two, shuffle_partitions, text_bytes

BASE = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 4 << 20
SLOT_WINDOWS = 400_000
PRIME = 2 ** 32 - 5                    # modulus of the second hash
CHECK_BASE = 0x5BD1E995
CHECK_SEED = 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the next block."""
    if len(_POWERS.get("up", ())) < n:
        size = power_of_two(max(n, 1024))
        for name, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _check_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """CHECK_BASE**i and CHECK_BASE**-i modulo PRIME for i < n, kept for the next block."""
    if len(_POWERS.get("check up", ())) < n:
        for name, b in (("check up", CHECK_BASE), ("check down", pow(CHECK_BASE, -1, PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, 1024):
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), PRIME)) % np.uint64(PRIME)])
            _POWERS[name] = p
    return _POWERS["check up"][:n], _POWERS["check down"][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and rolling hashes of the windows inside each of the consecutive documents.

    With prefix sums P of h[i] * BASE**i, the window at i hashes to (P[i+w] - P[i]) * BASE**-i.
    """
    n = len(h)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=prefix[1:])
    ends = np.repeat(np.cumsum(lengths), lengths)           # end of the document of each word
    starts = np.flatnonzero(np.arange(n) + window <= ends)
    out = (prefix[starts + window] - prefix[starts]) * down[starts]
    out ^= out >> np.uint64(32)                             # mix, so that the top bits are even
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return starts, out


def window_checks(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """The second hash of the windows at ``starts``: other word hashes, and a polynomial modulo PRIME."""
    if not len(starts):
        return np.empty(0, np.uint32)
    prime, (up, down) = np.uint64(PRIME), _check_powers(len(words) + 1)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w, CHECK_SEED) for w in words), np.uint64, len(words)) % prime
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(h * up[:-1] % prime, out=prefix[1:])           # below 2**64 for fewer than 2**32 words
    return ((prefix[starts + window] - prefix[starts]) % prime * down[starts] % prime).astype(np.uint32)


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows by both hashes, and where in it a new pair of hashes begins."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _block(texts: list) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode().split()                 # ASCII white space only
        lengths[i] = len(own)
        words += own
    return words, lengths


def _pack(first: np.ndarray, second: np.ndarray) -> bytes:
    """The low seven bytes of the first hash (the top one is known from the slot), then the second hash."""
    return first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + second.astype("<u4").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 11
    out = np.zeros((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8, 7 * n).reshape(-1, 7)
    return out.reshape(-1).view("<u8"), np.frombuffer(blob, "<u4", n, 7 * n)


def remove_repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 35,
                            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove every word that a repeated window of ``window`` words covers.

    A window is repeated if its word sequence starts at any other place of the corpus, the same
    document included; windows are judged on the input. Words are runs of bytes other than ASCII
    white space, unchanged.

    Returns a row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words
    joined by one blank), ``starts`` and ``ends`` (word positions of the maximal removed intervals).
    Null and empty texts have no words and give an empty ``kept_text``; a repeated row counts as
    another document, so its windows repeat; a null ``doc_id`` is returned as null; an empty table
    gives no rows; other columns are not read.

    Windows are compared by two independent hashes of 64 and 32 bits: some pair of n different
    windows collides with a chance of about n**2 / 2**97 (5e-10 for the 8.4e9 windows of 30 GB).
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size, spread = text_bytes(base, "text"), 2 * shuffle_partitions(spark)
    blocks = max(spread, -(-size // block_bytes))
    slots = max(256, power_of_two(max(spread, size / 6 / SLOT_WINDOWS)))
    shift = np.uint64(64 - (slots.bit_length() - 1))
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        words, lengths = _block(rows["text"].tolist())
        starts, hashes = window_hashes(word_hashes(words), lengths, window)
        checks = window_checks(words, starts, window)
        order, new = _distinct(hashes, checks)
        unique, second = hashes[order][new], checks[order][new]
        slot = (unique >> shift).astype(np.int64)
        used, first = np.unique(slot, return_index=True)
        edges = [*first, len(unique)]
        return pd.DataFrame({"block": np.full(len(used), rows["block"].iloc[0], np.int32), "slot": used.astype(np.int32),
                             "hashes": [_pack(unique[a:b], second[a:b]) for a, b in zip(edges, edges[1:])]})

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in rows["hashes"]]
        order, new = _distinct(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        marked = np.empty(len(order), bool)
        marked[order] = ~new | ~np.append(new[1:], True)     # a part's hashes differ, so equal ones are of other blocks
        marks = np.split(marked, np.cumsum([len(a) for a, _ in parts])[:-1])
        keep = [m.any() for m in marks]
        return pd.DataFrame({"block": rows["block"][keep].astype(np.int32), "slot": rows["slot"][keep].astype(np.int32),
                             "bits": [np.packbits(m).tobytes() for m in compress(marks, keep)]})

    def strip(rows: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        words, lengths = _block(rows["text"].tolist())
        starts, hashes = window_hashes(word_hashes(words), lengths, window)
        order, new = _distinct(hashes, window_checks(words, starts, window))
        unique, inverse = hashes[order][new], np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        twice = np.bincount(inverse, minlength=len(unique)) > 1
        edges = np.searchsorted(unique, np.arange(slots, dtype=np.uint64) << shift)
        edges = np.append(edges, len(unique))
        for slot, bits in zip(marks["slot"], marks["bits"]):
            a, b = edges[slot], edges[slot + 1]
            twice[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        cover = np.zeros(len(words) + 1, np.int64)
        hit = starts[twice[inverse]] if len(starts) else starts
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return pd.DataFrame(_documents(rows, words, lengths, gone))

    sent = base.groupBy("block").applyInPandas(send, "block int, slot int, hashes binary")
    marks = sent.groupBy("slot").applyInPandas(count, "block int, slot int, bits binary")
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(
        strip, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, starts array<int>, ends array<int>")


def _documents(rows: pd.DataFrame, words: list[bytes], lengths: np.ndarray, gone: np.ndarray) -> dict:
    kept, removed, starts, ends = [], [], [], []
    for a, b in _ranges(lengths):
        own = gone[a:b]
        kept.append(b" ".join(compress(words[a:b], ~own)).decode() if own.any() else b" ".join(words[a:b]).decode())
        removed.append(int(own.sum()))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        starts.append(edge[::2].astype(np.int32))
        ends.append(edge[1::2].astype(np.int32))
    return {"doc_id": rows["doc_id"], "n_words": lengths, "n_removed": np.array(removed, np.int64), "kept_text": kept,
            "starts": starts, "ends": ends}


def _ranges(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(lengths)
    return zip((ends - lengths).tolist(), ends.tolist())
