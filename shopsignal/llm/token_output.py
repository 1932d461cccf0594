"""Token-id output: documents encoded, in ascending doc_id order, as Simple-8b blocks.

A word has 64 bits: the low 4 select how many ids of how many bits the other 60 hold; selector 15
escapes to a single id of up to 60 bits. A block holds whole documents. Every RUN words it notes
how many ids came before, so a reader can start there, and decodes all words of one selector at a
time in numpy.

File format: parquet parts in doc_id order, a row per block, with ``part`` and ``block`` (its
place), ``n_ids``, ``doc_ids``, ``counts`` (ids of each document), ``offsets`` (ids before each run
of RUN words) and ``words`` (little-endian 64-bit words).
"""
from __future__ import annotations

import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopsignal.llm.common import kept, shuffle_partitions, steps

#: (ids in a word, bits of each): the selectors 0-12 of a word's 60 payload bits
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
RUN = 4096
SEGMENT = 600                    # a multiple of most counts, so runs of one width fill their words
BLOCK_IDS = 1 << 18
MEMORY_PIECES = 600_000
STEP = 4 << 20                  # bytes of text that are cut at once
LEARN = 4096                    # pieces that the library encodes at once


def _classes(ids: np.ndarray) -> np.ndarray:
    """The first selector wide enough for each id; ESCAPE if none is."""
    edges = np.array([1 << w for _, w in SELECTORS], np.uint64)
    if len(ids) and ids.max() < 1 << 17:
        table = np.searchsorted(edges, np.arange(1 << 17, dtype=np.uint64), "right").astype(np.int8)
        return table[ids]
    out = np.searchsorted(edges, ids, "right").astype(np.int8)
    out[out == len(SELECTORS)] = ESCAPE
    return out


def simple8b(ids: np.ndarray) -> np.ndarray:
    """Pack ids below 2**60 into 64-bit words, each with as many of the next ids as fit.

    Words end at every SEGMENT ids, so the segments' words are found side by side.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    need = _classes(ids)
    if need.max() == ESCAPE and (ids.astype(np.uint64) >> np.uint64(60)).any():
        raise ValueError("an id has more than 60 bits")
    rows = -(-n // SEGMENT)
    width = min(SEGMENT, n)
    padded = np.full((rows, width + 64), ESCAPE, np.int8)    # nothing fits beyond a segment's end
    flat = np.full(rows * width, ESCAPE, np.int8)
    flat[:n] = need
    padded[:, :width] = flat.reshape(rows, width)
    most = {1: padded}                                       # largest need of the next 1, 2, 4, .. ids
    for span in (1, 2, 4, 8, 16):
        last = most[span]
        most[2 * span] = np.maximum(last[:, :last.shape[1] - span], last[:, span:])
    choice = np.full((rows, width), ESCAPE, np.int8)
    for s, (count, _) in reversed(list(enumerate(SELECTORS))):
        half = 1 << (count.bit_length() - 1)
        fits = np.maximum(most[half][:, :width], most[half][:, count - half:count - half + width]) <= s
        choice[fits] = s
    choice = choice.ravel()
    at = _starts(_counts(choice), n, width)
    ids, picked = ids.astype(np.uint64), choice[at]
    out = (ids[at] << np.uint64(4)) | picked.astype(np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(picked == s)
        first = at[own]
        for k in range(1, count) if len(own) else ():
            out[own] |= ids[first + k] << np.uint64(4 + k * bits)
    return out


def _starts(taken: np.ndarray, n: int, width: int) -> np.ndarray:
    """The positions reached by jumping ``taken`` at each, from the start of every segment."""
    pos, out = np.arange(0, n, width), []
    end = np.minimum(pos + width, n)
    while len(pos):
        out.append(pos)
        pos = pos + taken[pos]
        live = pos < end
        pos, end = pos[live], end[live]
    return np.sort(np.concatenate(out))


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of Simple-8b words, as unsigned 64-bit integers."""
    select = (words & np.uint64(15)).astype(np.int8)
    ends = np.cumsum(_counts(select))
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, width) in [*enumerate(SELECTORS), (ESCAPE, (1, 60))]:
        rows = np.flatnonzero(select == s)
        if len(rows):
            first, body, mask = ends[rows] - count, words[rows] >> np.uint64(4), np.uint64((1 << width) - 1)
            for k in range(count):
                out[first + k] = (body >> np.uint64(k * width)) & mask
    return out


def _counts(select: np.ndarray) -> np.ndarray:
    counts = np.zeros(16, np.int64)
    counts[:len(SELECTORS)] = [c for c, _ in SELECTORS]
    counts[ESCAPE] = 1
    return counts[select]


#: white space and then a blank: the blank need not start a piece
ODD_BLANK = re.compile(r" (?<=\s )")
LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
CUT = re.compile(r"(?<=\S)(?= )")
TAIL = re.compile(r"([^\W\d_]+)([^\w\s]+)")
FIRST = "\ud800"                # marks a piece without a blank before it; no text can hold it
END = FIRST + FIRST


#: in Arrow strings, which hold no surrogates, the place of FIRST; texts that hold it themselves are odd
MARKER = "\U0010ffff"
SPACES = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: white space before a blank or around a line feed, a line feed at an end, or the marker
ODD = rf"{SPACES} |{SPACES}\n|\n{SPACES}|\A\n|\n\z|{MARKER}"


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. for each of ``sizes`` places."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with place for ``n`` entries."""
    return np.concatenate([a, np.zeros(max(0, n - len(a)), a.dtype)])


class PieceEncoder:
    """Ids of whole texts for a byte-level BPE whose words take the one blank before them.

    Such a tokenizer never joins a blank to a character before it other than white space, so a text
    is the concatenation of pieces that start at those blanks. It also splits letters or digits
    from marks after them, and single line feeds from what is around them. Each distinct piece is
    encoded by the library once and remembered, within a bound.
    """

    def __init__(self, path: str, end: int, memory: int = MEMORY_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark already runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.end = memory, end
        # a run of marks between a letter or digit and a blank; not those that the library's special strings hold
        special = {c for token in self.tokenizer.get_added_tokens_decoder().values() for c in token.content}
        self.marks = "[" + re.escape("".join(c for c in MARKS if c not in special)) + "]"
        self.mark = re.compile(rf"{self.marks}(?<=[^\W_].){self.marks}*(?= )")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self._line_feed()
        self._reset([END], np.array([end], np.uint32), np.array([1]))

    def _reset(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.memory = {p: i for i, p in enumerate(pieces)}
        self.n_ids, n = len(ids), len(pieces)
        self.ids = _room(ids.astype(np.uint32), 2 * len(ids))
        self.sizes, self.starts = _room(sizes.astype(np.int32), 2 * n), _room(np.cumsum(sizes) - sizes, 2 * n)
        self.uses = np.zeros(2 * n, np.int64)

    def split(self, text: str) -> list[str]:
        """The text's pieces; the blank before a piece is left out, FIRST marks that there is none."""
        if ODD_BLANK.search(text):
            return [p[1:] if p[0] == " " else FIRST + p for p in CUT.split(text)]
        if "\n" in text:
            text = LINE.sub(f" {FIRST}\n {FIRST}", text)
        out = self.mark.sub(f" {FIRST}\\g<0>", text).split(" ")
        if out[0]:
            out[0] = FIRST + out[0]
            return out
        return out[1:]

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has, the end id included.

        Texts without odd white space are cut by Arrow, all of them at once, and only their distinct pieces are looked up.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        filled = pc.binary_length(column).to_numpy(zero_copy_only=False) > 0
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False) & filled
        plain = np.flatnonzero(filled & ~odd)
        n = np.zeros(len(column), np.int64)
        cut = self._cut(column.take(pa.array(plain)))
        n[plain] = np.diff(cut.offsets.to_numpy())
        slow = [self.split(column[int(i)].as_py()) for i in np.flatnonzero(odd)]
        n[odd] = [len(x) for x in slow]
        # piece numbers in the texts' order, with END after each
        ends = np.cumsum(n + 1)
        k = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        k[_spread(ends[plain] - 1 - n[plain], n[plain])] = self._plain_numbers(cut.flatten())
        k[_spread((ends - 1 - n)[odd], n[odd])] = self._numbers([p for x in slow for p in x])
        k[ends - 1] = self._numbers([END])[0]
        sizes = self.sizes[k].astype(np.int64)
        last = np.cumsum(sizes)
        ids = self.ids[_spread(self.starts[k], sizes)]
        self.uses += np.bincount(k, minlength=len(self.uses))
        if len(self.memory) > self.limit:
            self._forget()
        return ids, np.diff(last[ends - 1], prepend=0)

    def _cut(self, column: pa.Array) -> pa.ListArray:
        """Pieces as ``split`` makes them, MARKER in the place of FIRST."""
        column = pc.replace_substring(column, "\n", f" {MARKER}\n {MARKER}")
        column = pc.replace_substring_regex(column, rf"([\pL\pN])({self.marks}+) ", rf"\1 {MARKER}\2 ")
        blank = pc.starts_with(column, " ")
        kind = pa.large_string() if pa.types.is_large_string(column.type) else pa.string()
        column = pc.if_else(blank, pc.utf8_slice_codeunits(column, 1), pc.binary_join_element_wise(pa.scalar(MARKER, kind), column, pa.scalar("", kind)))
        return pc.split_pattern(column, " ")

    def _plain_numbers(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(pc.starts_with(coded.dictionary, MARKER).to_numpy(zero_copy_only=False)).tolist():
            names[i] = FIRST + names[i][1:]
        return self._numbers(names.tolist())[coded.indices.to_numpy()]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The remembered numbers of pieces; new ones are learned."""
        k = np.fromiter(map(self.memory.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(k < 0).tolist()
        if missing:
            new = dict.fromkeys([pieces[i] for i in missing])
            in_turn = self._learn(new)
            if in_turn and len(new) == len(missing):
                k[missing] = np.arange(len(self.memory) - len(new), len(self.memory))
            else:
                k[missing] = [self.memory[pieces[i]] for i in missing]
        return k

    def _learn(self, pieces: dict[str, None]) -> bool:
        """Remember new pieces; whether they got the next numbers in turn."""
        # a word with marks behind it, where the cuts left it whole, is its two parts
        ends = [p for p in pieces if not p[-1:].isalnum()]
        parts = {p: (m[1], FIRST + m[2]) for p in ends if (m := TAIL.fullmatch(p))}
        whole = list(pieces)
        if parts:
            more = dict.fromkeys(x for two in parts.values() for x in two if x not in self.memory)
            whole = [p for p in whole if p not in parts] + [p for p in more if p not in pieces]
        for a in range(0, len(whole), LEARN):
            some = whole[a:a + LEARN]
            self._store(some, *self._library(some))
        if parts:
            two = [(self._own(a), self._own(b)) for a, b in parts.values()]
            self._store(list(parts), np.concatenate(list(chain.from_iterable(two))), np.array([len(a) + len(b) for a, b in two]))
        return not parts

    def _line_feed(self) -> int | None:
        """The id of a line feed that stands alone between two pieces; None if the tokenizer has none."""
        own = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        feed = own("\n")
        whole = len(feed) == 1 and own("a\n a\na") == own("a") + feed + own(" a") + feed + own("a")
        return feed[0] if whole and not any("\n" in t for t in self.special) else None

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has.

        Pieces without white space go to the library as one text, a line on its own each; it takes its time per text."""
        texts = [p[1:] if p[:1] == FIRST else " " + p for p in pieces]
        joined = "\n".join(texts)
        if self.feed is not None and joined.split() == [t[t[:1] == " ":] for t in texts] and not any(t in joined for t in self.special):
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) == len(texts) - 1:
                return np.delete(ids, feeds), np.diff(np.r_[-1, feeds, len(ids)]) - 1
        elif len(pieces) > 1:               # what keeps the others from being joined goes alone
            odd = np.array([t.split() != [t[t[:1] == " ":]] or any(s in t for s in self.special) for t in texts])
            if odd.any() and not odd.all():
                groups = [self._library([p for p, o in zip(pieces, odd.tolist()) if o == kind]) for kind in (False, True)]
                sizes = np.zeros(len(pieces), np.int64)
                sizes[~odd], sizes[odd] = groups[0][1], groups[1][1]
                first = np.zeros(len(pieces), np.int64)
                first[~odd], first[odd] = np.cumsum(groups[0][1]) - groups[0][1], len(groups[0][0]) + np.cumsum(groups[1][1]) - groups[1][1]
                return np.concatenate([groups[0][0], groups[1][0]])[_spread(first, sizes)], sizes
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def _own(self, piece: str) -> np.ndarray:
        k = self.memory[piece]
        return self.ids[self.starts[k]:self.starts[k] + self.sizes[k]]

    def _store(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.memory)
        self.memory.update(zip(pieces, range(n, n + len(pieces))))
        more, end = len(ids), n + len(pieces)
        if self.n_ids + more > len(self.ids):
            self.ids = _room(self.ids, 2 * (self.n_ids + more))
        if end > len(self.sizes):
            self.sizes, self.starts, self.uses = (_room(a, 2 * end) for a in (self.sizes, self.starts, self.uses))
        self.ids[self.n_ids:self.n_ids + more] = ids
        self.sizes[n:end], self.starts[n:end] = sizes, self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += more

    def _forget(self) -> None:
        """Keep the half of the pieces that were used most."""
        names, self.memory = list(self.memory), {}
        keep = np.sort(np.argsort(-self.uses[:len(names)], kind="stable")[:self.limit // 2])
        keep = np.unique(np.concatenate([[0], keep]))
        sizes = self.sizes[keep].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[keep] - (ends - sizes), sizes)]
        names = [names[i] for i in keep.tolist()]
        self._reset(names, ids, sizes)


def _row(part: int, block: int, docs: list, counts: list, ids: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    all_ids = np.concatenate(ids)
    words = simple8b(all_ids)
    before = np.concatenate(([0], np.cumsum(_counts((words & np.uint64(15)).astype(np.int8)))))[:-1:RUN] if len(words) else []
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "n_ids": pa.array([len(all_ids)], pa.int64()),
        "doc_ids": pa.array([docs], pa.list_(kind)), "counts": pa.array([counts], pa.list_(pa.int64())),
        "offsets": pa.array([before], pa.list_(pa.int64())), "words": pa.array([words.astype("<u8").tobytes()], pa.binary())})


def write_tokens(docs: DataFrame, folder: str, path: str, *, end: int, doc_id: str = "doc_id", text: str = "text",
                 block_ids: int = BLOCK_IDS, step: int = STEP, memory: int = MEMORY_PIECES) -> None:
    """Write the ids of every whole text, and the id ``end`` after each, to ``folder``.

    Documents go in ascending doc_id, null first; rows of one doc_id in the order of a hash of their texts,
    by which a frequent doc_id is dealt to many tasks, and a repeated row is written again. Null and empty texts are the end id alone. An
    empty table writes a folder without rows; other columns are not read. ``path`` is a tokenizers
    .json of a byte-level BPE with the usual blank-before-word pattern. ``step`` bytes of text are cut at once
    and ``memory`` pieces remembered by a worker: they bound its memory and change no result.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        part, block, ids, names, counts, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        encoder, arrow = kept(("pieces", path, end, memory), lambda: PieceEncoder(path, end, memory)), pa.int64()
        for batch in batches:
            arrow, keys = batch.column(0).type, iter(batch.column(0).to_pylist())
            for texts in steps(batch.column(1), step):
                flat, n = encoder.encode(texts)
                ends = np.cumsum(n)
                at = 0
                for i, z in enumerate(ends.tolist()):
                    names.append(next(keys))
                    counts.append(int(n[i]))
                    held += counts[-1]
                    if held >= block_ids:
                        ids.append(flat[at:z])
                        yield _row(part, block, names, counts, ids, arrow)
                        block, ids, names, counts, held, at = block + 1, [], [], [], 0, z
                if at < len(flat):
                    ids.append(flat[at:])
        if names:
            yield _row(part, block, names, counts, ids, arrow)

    # equal rows are interchangeable: their numbers deal them out too
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    base.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}) \
        .repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text") \
        .mapInArrow(encode, f"part int, block long, n_ids long, doc_ids array<{kind}>, counts array<long>, offsets array<long>, words binary") \
        .write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, *, with_ids: bool = False) -> DataFrame:
    """Per document of a written folder: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before; the crc covers the ids as little-endian
    unsigned 32-bit integers.
    """
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    in_part = Window.partitionBy("part").orderBy("block")
    places = blocks.select("part", "block", "n_ids", (F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("here"))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")) \
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))     # a row per part
    places = places.join(parts, "part").select("part", "block", (F.col("before") + F.col("here")).alias("base"))

    def read(batches):
        for batch in batches:
            for part, block, names, counts, words in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "doc_ids", "counts", "words"))):
                ids = decode(np.frombuffer(words, "<u8")).astype("<u4")
                ends = np.cumsum(np.array(counts, np.int64))
                own = [ids[z - n:z] for z, n in zip(ends.tolist(), counts)]
                out = {"part": pa.array([part] * len(own), pa.int32()), "block": pa.array([block] * len(own), pa.int64()),
                       "doc_id": pa.array(names, batch.schema.field("doc_ids").type.value_type),
                       "at": pa.array(ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"part int, block long, doc_id {kind}, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = blocks.select("part", "block", "doc_ids", "counts", "words").mapInArrow(read, schema)
    return rows.join(places, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
