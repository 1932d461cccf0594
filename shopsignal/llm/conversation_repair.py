"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``, by Four-Russians block tables.

Rows are taken by turn (null first), rows of one turn by role and by the MD5 digest of their text. A row
is blank (no character but white space), else a duplicate (its role and text stand earlier in the
conversation), else truncated (its last character but white space is none of ``. ! ?``). Edits: Keep costs
0, Rerole to user or assistant 3, Delete 4 (the only edit of a blank or duplicate row), Insert of a row
with an empty text 3; a truncated row that stays adds 3. Of the cheapest edit scripts the ASCII-least
string of initials is taken; it fixes roles and texts of the result.

Method: a row becomes one of nine symbols (must go; or s, u, a or other initial, truncated or not). The
cost to go from each of four states of the pattern (start, after s, after u, after a) is a vector that,
less its least entry, takes few values. ``Tables`` finds them all and precomputes, for every vector and
every block of BLOCK symbols, the vector before the block. A conversation is read backward block by block,
one lookup each; the script is then written forward, expanding each block backward from its vector, and
always taking the least letter that keeps the cost to go, so ties are safe at block ends too.

Spark: the first row of each role and text is found by a grouping with partial sums (the only shuffle of
texts but the next one); later copies travel as counts without text. Rows are range-partitioned on their
order and checkpointed, so a conversation of any size is spread over tasks, partitions of about
``part_bytes`` of text. Conversations inside one partition are solved there. For those that cross
partition ends, each partition reports one vector map for its first and its last conversation (as many
entries as there are vectors), the driver chains these few numbers, a second look gives the states at the
ends, and every piece is then written in place. The driver receives one row per partition.

Null roles and texts count as one space, so such rows are blank, with the role " ". Null ids are one
conversation, null turns come first. Empty texts are blank. Long texts are judged whole. Repeated rows are
duplicates of the first. Extra columns, whatever their names, are left behind; an empty table gives an
empty result.
"""
from __future__ import annotations

from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import materialize, shuffle_partitions, stream_sha256
from shopsignal.session import ensure_checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: symbols: 0 must go, 1 + 2 * initial + truncated, 9 no row (fills up a block)
INITIALS, GONE, FILL = "sua", 0, 9
BLOCK = 4
#: states: 0 start, 1 after s, 2 after u, 3 after a; an inserted or reroled row leads to NEXT
NEXT = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}


def _with_inserts(g: list[int]) -> list[int]:
    for _ in range(3):
        g = [min(g[s], INSERT + g[NEXT[s]]) for s in range(4)]
    return g


END = tuple(_with_inserts([0, 10**6, 10**6, 0]))


def _moves(symbol: int, s: int):
    """(letter, cost, state after) of the edits of one row, letters ascending."""
    yield "D", DELETE, s
    if symbol != GONE:
        initial, cut = divmod(symbol - 1, 2)
        if (s, initial) in KEPT:
            yield "K", KEEP + CUT_OFF * cut, KEPT[s, initial]
        yield "R", REROLE + CUT_OFF * cut, NEXT[s]


def before(symbol: int, g: tuple) -> tuple:
    """Costs to go before a row, from those after it."""
    if symbol == FILL:
        return g
    return tuple(_with_inserts([min(c + g[t] for _, c, t in _moves(symbol, s)) for s in range(4)]))


class Tables:
    """All normalised vectors, and for each vector and block of symbols the vector before it and what was subtracted."""

    def __init__(self):
        self.vectors, number, i = [END], {END: 0}, 0
        step = []
        while i < len(self.vectors):
            row = []
            for symbol in range(10):
                g = before(symbol, self.vectors[i])
                low = min(g)
                g = tuple(x - low for x in g)
                if g not in number:
                    number[g] = len(self.vectors)
                    self.vectors.append(g)
                row.append((number[g], low))
            step.append(row)
            i += 1
        to, off = np.array(step, dtype=np.int64).transpose(2, 0, 1)
        n = len(self.vectors)
        self.to, self.off = np.arange(n)[:, None], np.zeros((n, 1), dtype=np.int64)
        for _ in range(BLOCK):      # one more symbol on the left; a block's code has its first symbol as the last digit
            self.off = (self.off[:, :, None] + off[self.to]).reshape(n, -1)
            self.to = to[self.to].reshape(n, -1)
        self.trace = lru_cache(maxsize=200_000)(self._trace)

    def _trace(self, code: int, right: int, state: int) -> tuple[str, int]:
        """The least cheapest letters of a block, entered in ``state``, before vector ``right``; and the state after it."""
        symbols = [code // 10 ** i % 10 for i in range(BLOCK)]
        costs = [self.vectors[right]]
        for symbol in reversed(symbols):
            costs.append(before(symbol, costs[-1]))
        costs.reverse()
        out = []
        for i, symbol in enumerate(symbols):
            while symbol != FILL:
                letter, state, done = self._least(symbol, state, costs[i], costs[i + 1])
                out.append(letter)
                if done:
                    break
        return "".join(out), state

    @staticmethod
    def _least(symbol: int, s: int, here: tuple, after: tuple) -> tuple[str, int, bool]:
        edits = [(letter, cost + after[t], t, True) for letter, cost, t in _moves(symbol, s)]
        edits.append(("I", INSERT + here[NEXT[s]], NEXT[s], False))
        return min((letter, t, done) for letter, cost, t, done in edits if cost == here[s])

    def codes(self, symbols: bytes) -> list[int]:
        """Blocks from left to right, the last one filled up."""
        a = np.frombuffer(symbols, dtype=np.uint8)
        a = np.concatenate([a, np.full(-len(a) % BLOCK, FILL, dtype=np.uint8)]).reshape(-1, BLOCK)
        return (a @ (10 ** np.arange(BLOCK))).tolist()

    def rights(self, codes: list[int], right: int) -> list[int]:
        """The vector after each block (and, at the end of the list, before the first)."""
        out = [right]
        for code in reversed(codes):
            right = int(self.to[right, code])
            out.append(right)
        out.reverse()
        return [*out[1:], out[0]]

    def write(self, symbols: bytes, right: int, state: int, ends: bool) -> tuple[str, int]:
        """The letters of a run of rows and the state after it; with the inserts after the last row where the conversation ends."""
        codes = self.codes(symbols)
        letters = []
        for code, vector in zip(codes, self.rights(codes, right)):
            piece, state = self.trace(code, vector, state)
            letters.append(piece)
        while ends and state not in (0, 3):
            letters.append("I")
            state = NEXT[state]
        return "".join(letters), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


# ------------------------------------------------------------------------------------------ rows in order
def damage_by_hash(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20, for trials: 0 drops the row (``present`` is false), 1 empties its text,
    2 takes its ``. ! ?``, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(word("role")).alias("role"),
        F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text")).alias("text"),
        (k != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def _symbol(role: Column, ends: Column) -> Column:
    first = F.left(role, F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return (1 + 2 * initial + F.when(F.right(ends, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)).cast("tinyint")


def ordered_rows(rows: DataFrame, part_bytes: int, present: str | None = None) -> DataFrame:
    """First rows with their text and counts of all copies, range-partitioned and sorted by their order, checkpointed.

    kind 0: the first row of a role and text (symbol, text); kind 1: n copies of a row, the first one included.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text"), (F.col(present) if present else F.lit(True)).alias("present"))
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    copies = (r.select("conv_id", "turn", "role", digest.alias("digest"), (ends == "").alias("blank"), "present")
              .groupBy("conv_id", "turn", "role", "digest", "blank", "present").agg(F.count(F.lit(1)).alias("n"))
              .select("conv_id", "turn", "role", "digest", F.lit(1).cast("tinyint").alias("kind"), F.lit(None).cast("string").alias("text"),
                      F.lit(0).alias("size"), F.when(F.col("blank"), 1).otherwise(0).cast("tinyint").alias("symbol"), F.when(F.col("present"), F.col("n")).otherwise(0).alias("n")))
    firsts = (r.filter(F.col("present") & (ends != "")).groupBy("conv_id", "role", "text")
              .agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("untimed"))
              .select("conv_id", F.when(~F.col("untimed"), F.col("turn")).alias("turn"), "role", digest.alias("digest"),
                      F.lit(0).cast("tinyint").alias("kind"), "text",
                      F.octet_length("text").alias("size"), _symbol(F.col("role"), ends).alias("symbol"), F.lit(1).cast("long").alias("n")))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // part_bytes))
    order = ["conv_id", "turn", "role", "digest"]
    return (firsts.unionByName(copies).repartitionByRange(parts, *order).sortWithinPartitions(*order, "kind")
            .withColumn("pid", F.spark_partition_id()).checkpoint(eager=True))


class Segment:
    """The rows of one conversation inside one partition."""

    __slots__ = ("conv", "symbols", "texts", "turns", "roles", "blank", "duplicate", "truncated", "min_turn", "max_turn", "distinct", "illegal", "first", "last", "size")

    def __init__(self, conv):
        self.conv, self.symbols, self.texts, self.roles, self.size = conv, bytearray(), [], [], 0      # texts: places in the partition's column
        self.blank = self.duplicate = self.truncated = self.distinct = self.illegal = 0
        self.min_turn = self.max_turn = self.first = self.last = None

    def add(self, turn, role, symbol, n, place, size, fault):
        if not n:
            return
        if turn is not None:
            if self.max_turn is None or turn != self.max_turn:
                self.distinct += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = turn
        initial = role[:1]
        legal = self.last is None or self.last + initial in ("su", "ua", "au")
        self.illegal += (not legal) + (n - 1)       # an initial twice is never legal
        if self.first is None:
            self.first = initial
        self.last = initial
        self.symbols += bytes([symbol]) * n
        if symbol:
            self.texts.append(place)
            self.roles.append(role)
            self.size += size
            self.truncated += (symbol - 1) % 2
        elif fault == "blank":
            self.blank += n
        else:
            self.duplicate += n


def segments(batches) -> tuple[int, list[Segment]]:
    """The partition's number and its conversations in order; of texts only places and sizes."""
    pid, out, own = -1, [], object()
    previous, place = None, 0
    for batch in batches:
        d = {c: batch.column(c).to_pylist() for c in ("pid", "conv_id", "turn", "role", "digest", "kind", "size", "symbol", "n")}
        for pid, conv, turn, role, digest, kind, size, symbol, n in zip(*d.values()):
            if not out or conv != own:
                out.append(Segment(conv))
                own = conv
            key = (conv, turn, role, digest)
            if kind == 0:
                out[-1].add(turn, role, symbol, 1, place, size, None)
                previous = key
            elif n:
                out[-1].add(turn, role, GONE, n - (previous == key), None, 0, "blank" if symbol else "duplicate")
            place += 1
    return pid, out


# ------------------------------------------------------------------------------------------ pieces
EDGE = "struct<conv: {0}, n: long, to: array<int>, first: string, last: string, min_turn: long, max_turn: long>"
ENDS = f"pid int, head {EDGE}, tail {EDGE}, same boolean"
ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_()}


def _edge(s: Segment) -> dict:
    t = tables()
    state = np.arange(len(t.vectors))
    for code in reversed(t.codes(bytes(s.symbols))):
        state = t.to[state, code]
    return {"conv": s.conv, "n": len(s.symbols), "to": state.tolist(), "first": s.first, "last": s.last, "min_turn": s.min_turn, "max_turn": s.max_turn}


def _report_edges(batches, schema):
    pid, found = segments(batches)
    if found:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "head": _edge(found[0]), "tail": _edge(found[-1]), "same": len(found) == 1}], schema=schema)


def _chains(edges: list) -> list[list[tuple[int, str, dict]]]:
    """Runs of (partition, head or tail, report) that belong to one conversation, of two partitions at least."""
    out, run = [], []
    for e in sorted(edges, key=lambda e: e["pid"]):
        if run and run[-1][2]["conv"] == e["head"]["conv"]:
            run.append((e["pid"], "head", e["head"]))
        else:
            out.append(run)
            run = [(e["pid"], "head", e["head"])] if e["same"] else []
        if not e["same"]:
            out.append(run)
            run = [(e["pid"], "tail", e["tail"])]
    out.append(run)
    return [r for r in out if len(r) > 1]


def _plan(edges: list) -> dict:
    """For each piece of a conversation that crosses partitions: the vector after it, whether it is the last one, and what came before."""
    plan = {}
    for run in _chains(edges):
        right = 0
        for i in reversed(range(len(run))):
            pid, side, e = run[i]
            plan[pid, side] = {"right": right, "ends": i == len(run) - 1, "state": 0, "before": None, "turn": None}
            right = e["to"][right]
        last = turn = None
        for pid, side, e in run:
            plan[pid, side] |= {"before": last, "turn": turn}
            last, turn = (e["last"] if e["last"] is not None else last), (e["max_turn"] if e["max_turn"] is not None else turn)
    return plan


def _sides(found: list[Segment]):
    """(place in the list, head or tail) of the first and the last conversation."""
    return [(0, "head")] + ([(len(found) - 1, "tail")] if len(found) > 1 else [])


def _states(sorted_rows: DataFrame, plan: dict, edges: list) -> None:
    """Fill in the state in which each crossing piece is entered."""
    def run(batches):
        pid, found = segments(batches)
        t = tables()
        for k, side in _sides(found):
            if p := plan.get((pid, side)):
                after = [t.write(bytes(found[k].symbols), p["right"], s, False)[1] for s in range(4)]
                yield pa.RecordBatch.from_pylist([{"pid": pid, "side": side, "after": after}])

    after = {(r["pid"], r["side"]): r["after"] for r in sorted_rows.drop("text").mapInArrow(run, "pid long, side string, after array<long>").collect()}
    for chain in _chains(edges):
        state = 0
        for pid, side, _ in chain:
            plan[pid, side]["state"] = state
            state = after[pid, side][state]


def _pieces(pid: int, s: Segment, texts: list[str], p: dict | None, piece_bytes: int):
    """The script and the repaired text of one conversation's rows, cut where the text passes ``piece_bytes``."""
    t = tables()
    right, state, ends = (p["right"], p["state"], p["ends"]) if p else (0, 0, True)
    after_state = state
    audit, _ = t.write(bytes(s.symbols), right, state, ends)
    illegal, distinct = s.illegal, s.distinct
    if p and s.first is not None and p["before"] is not None:
        illegal += p["before"] + s.first not in ("su", "ua", "au")
    if p and p["turn"] is not None and s.min_turn == p["turn"]:
        distinct -= 1
    head = {"conv_id": s.conv, "pid": pid, "n_rows": len(s.symbols), "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated,
            "illegal": illegal, "min_turn": s.min_turn, "max_turn": s.max_turn, "distinct_turns": distinct}
    state, row, lines, size, cost, at, start, seq = after_state, -1, [], 0, 0, 0, 0, 0
    symbols, kept = s.symbols, 0
    none = {k: 0 for k in ("n_rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns")} | {"min_turn": None, "max_turn": None}

    def piece(stop):
        return head | (none if seq else {}) | {"seq": seq, "cost": cost, "audit": audit[start:stop], "repaired": "\n".join(lines) if lines else None}

    for at, letter in enumerate(audit):
        if letter != "I":
            row += 1
        symbol = symbols[row] if letter != "I" else None
        if letter == "D":
            cost += DELETE
        elif letter == "I":
            cost += INSERT
            state = NEXT[state]
            lines.append("user:" if state == 2 else "assistant:")
        else:
            cost += (REROLE if letter == "R" else KEEP) + CUT_OFF * ((symbol - 1) % 2)
            state = NEXT[state] if letter == "R" else KEPT[state, (symbol - 1) // 2]
            role = s.roles[kept] if letter == "K" else "user" if state == 2 else "assistant"
            lines.append(f"{role}:{texts[kept]}")
        if letter != "I" and symbol != GONE:
            kept += 1
        if lines:
            size += len(lines[-1]) if letter != "D" else 0
        if size > piece_bytes and at + 1 < len(audit):
            yield piece(at + 1)
            seq, start, lines, size, cost = seq + 1, at + 1, [], 0, 0
    yield piece(len(audit))


def repair(rows: DataFrame, present: str | None = None, part_bytes: int = 32 << 20, piece_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Edit scripts and repaired conversations of ``rows`` (conv_id, turn, role, text). Where the column ``present`` is false
    the row is not there, but its conversation is reported.

    Two tables of the same columns: conversations that are one piece, and the pieces of the others, which follow
    each other by (pid, seq); a piece's ``repaired`` holds ``role:text`` lines joined by newlines, null without any line.
    Counts and costs of a conversation's pieces add up.
    """
    sorted_rows = ordered_rows(rows, part_bytes, present)
    kind = rows.schema["conv_id"].dataType.simpleString()
    edge = pa.struct([("conv", ARROW[kind]), ("n", pa.int64()), ("to", pa.list_(pa.int32())), ("first", pa.string()), ("last", pa.string()),
                      ("min_turn", pa.int64()), ("max_turn", pa.int64())])
    edge_schema = pa.schema([("pid", pa.int32()), ("head", edge), ("tail", edge), ("same", pa.bool_())])
    edges = [r.asDict(recursive=True) for r in sorted_rows.drop("text").mapInArrow(lambda b: _report_edges(b, edge_schema), ENDS.format(kind)).collect()]   # a row per partition
    plan = _plan(edges)
    if plan:
        _states(sorted_rows, plan, edges)
    spec = (f"conv_id {kind}, pid long, n_rows long, blank long, duplicate long, truncated long, illegal long, min_turn long, max_turn long, "
            "distinct_turns long, seq long, cost long, audit string, repaired string")

    def run(batches, crossing):
        batches = list(batches)
        pid, found = segments(batches)
        if not found:
            return
        sides = {k: plan.get((pid, side)) for k, side in _sides(found)}
        column = pa.chunked_array([b.column("text") for b in batches])
        chosen = [(k, s) for k, s in enumerate(found) if (sides.get(k) is not None or s.size > piece_bytes) == crossing]
        places = [i for _, s in chosen for i in s.texts]
        texts, out, size = iter(column.take(pa.array(places, pa.int64())).to_pylist()), [], 0
        for k, s in chosen:
            for p in _pieces(pid, s, list(islice(texts, len(s.texts))), sides.get(k), piece_bytes):
                out.append(p)
                size += len(p["repaired"] or "") + 200
                if size > 4 * piece_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in spec.split(", ")])
    return (sorted_rows.mapInArrow(lambda b: run(b, False), spec), sorted_rows.mapInArrow(lambda b: run(b, True), spec))



def conversations(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit and the SHA-256 digest of its repaired lines, from the tables of ``repair``.

    Texts of one piece are hashed where they are; SHA-256 has to see the others' pieces one after the other, so
    each of these conversations is a stream through one task, a piece at a time.
    """
    parts = materialize(parts, "repair-parts")
    counts = ["n_rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns", "cost"]
    done = whole.select("conv_id", *counts, "min_turn", "max_turn", "audit", F.sha2(F.coalesce("repaired", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
    summed = parts.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"),
        F.array_sort(F.collect_list(F.struct("pid", "seq", "audit"))).alias("audits"))
    summed = summed.withColumn("audit", F.array_join(F.col("audits.audit"), "")).drop("audits")
    hashed = stream_sha256(parts, ["conv_id"], ["pid", "seq"], "repaired", "\n", "repaired_sha256").withColumnRenamed("conv_id", "hashed_id")
    joined = summed.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id"))).select(done.columns)
    return done.unionByName(joined)
