"""Conversation prefix trie: a z-fast trie over conversations' turns, kept in tables.

A conversation is a string whose symbols are its turns (role and text). A prefix is named by its depth
and the sum of one hash per (depth, turn): 28 decimal digits from two 64-bit hashes of the turns' MD5
digests, so that some two of n different prefixes share a name with a chance of about n^2 / 2e28 (5e-9
for ten billion). ``paths`` has a row for every prefix of every conversation, by one ordered scan that
splits a conversation of any length over tasks.

Method: the trie holds compacted nodes only (those that end a conversation or branch). A node's edge
covers the depths (p, e]; the two-fattest number in it, the one divisible by the highest power of two, is
the depth of the node's handle, and the table of nodes is a dictionary by handle. A conversation's exit node
is found by fat binary search: for k from log2 of the longest conversation down to 0, the depth f in the
remaining interval that 2^k divides is looked up; a hit moves the interval's start to the node's extent, a miss its
end before f. In step k only prefixes and handles at odd multiples of 2^k take part, so all steps together
shuffle each prefix and each node once. The rest of the exit edge is then compared turn by turn.
Conversations (distinct ones; copies are counted first) are inserted in two batches: exit edges are
split where conversations leave them, and what lies below is new: prefixes are grouped by name, and those
that end or branch become nodes. Members, leaves and bytes are summed over subtrees by pointer doubling on
the compacted nodes, and at last edges are expanded, one row per depth.

The prefix of a turn's ancestors never meets in one task: groupings are summed before the shuffle, joins on
a common prefix are split by the adaptive join, long edges are expanded in pieces of EDGE_PIECE depths. Ids that end at a
node are packed in order into texts of CHUNK bytes for its SHA-256 digest. Nothing but counts reaches the driver.

Rows without a conversation id take no part. Null roles and texts are empty; null turns come first, rows
of one turn stand in the order of the digest of role and text. Empty texts are turns like any other, long ones
are hashed whole, repeated rows are turns of their own. A conversation without turns ends at the root; a
table without conversations has no nodes. Extra columns, whatever their names, are left behind.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignal.llm.common import materialize, shuffle_partitions, stream_sha256
from shopsignal.operators.numeric import ordered_scan

#: hash shares of the distinct conversations that are inserted in one batch each
BATCHES = (1 / 16, 15 / 16)
EDGE_PIECE = 1 << 12
CHUNK = 1 << 16
NAME = "decimal(38,0)"


def root_name() -> Column:
    return F.lit(0).cast(NAME)


# ------------------------------------------------------------------------------------------ conversations and prefixes
def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn's digest, UTF-8 bytes of its text): all that the trie needs of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"))           # equal rows need an order of some kind, to be dealt out
    return ordered_scan(slim, ["conv_id"], ["turn", "digest", "row"], prefix="own_").select(
        "conv_id", F.col("own_rn").cast("long").alias("place"), "digest", "bytes")


def share_openings(conversations: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations as a trial needs them, with shared openings: (conv_id, depth, digest, bytes), and all ids.

    Conversation c gets the first h turns of conversation c - c % group, then its own turns after its first h;
    h is crc32(c) % longest.
    """
    turns = materialize(turns_in_order(conversations), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest))
    ids = turns.select("conv_id").distinct().withColumn("h", h)
    asked = ids.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = turns.filter(F.col("place") < longest).select(F.col("conv_id").alias("base"), "place", "digest", "bytes")
    opening = asked.join(heads, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    opening = materialize(opening, "openings")
    got = opening.groupBy("conv_id").agg(F.count(F.lit(1)).alias("got"))
    rest = (turns.withColumn("h", h).filter("place > h").join(got, "conv_id", "left")
            .select("conv_id", (F.coalesce("got", F.lit(0)) + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes"))
    return opening.unionByName(rest), ids.select("conv_id")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, up, bytes, total, k) of every prefix: its name and its parent's, its last turn's bytes and all its
    bytes, and how often 2 divides the depth. ``turns`` (conv_id, depth from 1 without gaps, digest, bytes)."""
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(10**14)).cast("decimal(14,0)")
    symbol = (part("depth", "digest") * F.lit(10**14).cast("decimal(15,0)") + part("digest", "depth")).cast("decimal(28,0)")
    named = turns.withColumn("symbol", symbol).drop("digest")
    scanned = ordered_scan(named, ["conv_id"], ["depth"], sum_col=["symbol", "bytes"], prefix="p_")
    low = F.col("depth").bitwiseAND(-F.col("depth"))
    return materialize(scanned.select(
        "conv_id", "depth", F.col("p_cum_symbol").cast(NAME).alias("name"), (F.col("p_cum_symbol") - F.col("symbol")).cast(NAME).alias("up"),
        "bytes", F.col("p_cum_bytes").cast("long").alias("total"), top_bit(low).alias("k")).sortWithinPartitions("k"), "prefixes")


def sequences(p: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The end of every conversation (conv_id, name, depth, total), and the distinct ones (seq, name, depth, total, n)."""
    none = F.lit(0).cast("long")
    both = p.select("conv_id", "depth", "name", "total").unionByName(      # a conversation without turns ends at the root
        ids.select("conv_id", none.alias("depth"), root_name().alias("name"), none.alias("total")))
    ends = materialize(both.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"), F.max("depth").alias("depth"), F.max("total").alias("total")), "ends")
    distinct = ends.groupBy("name", "depth", "total").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("n"))
    return ends, materialize(distinct, "sequences")


# ------------------------------------------------------------------------------------------ the z-fast trie
def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides: high with all bits below the first that differs from low cleared."""
    bit = F.pow(F.lit(2), top_bit(low.bitwiseXOR(high))).cast("long")
    return high - high % bit


def top_bit(c: Column) -> Column:
    """The place of a positive number's highest bit."""
    return F.length(F.bin(c)) - 1


def with_handles(nodes: DataFrame, p: DataFrame) -> DataFrame:
    """Nodes (name, depth, owner, low) with what the owner's path tells of depths low, low + 1, the handle's and the extent's:
    parent, first (name of the edge's first prefix), handle, f, k, spent (bytes down to low), total."""
    f = two_fattest(F.col("low"), F.col("depth"))
    asked = nodes.withColumn("f", f).select("*", F.explode(F.array_distinct(F.array(F.col("low") + 1, F.col("f"), F.col("depth")))).alias("at"))
    row = asked.join(p.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("name").alias("there"), "up", "bytes", F.col("total").alias("sum"), "k"), ["owner", "at"])
    first, handle, extent = F.col("at") == F.col("low") + 1, F.col("at") == F.col("f"), F.col("at") == F.col("depth")
    pick = lambda when, c: F.max(F.when(when, c))
    return row.groupBy("name", "depth", "owner", "low", "f").agg(
        pick(first, F.col("up")).alias("parent"), pick(first, F.col("there")).alias("first"), pick(handle, F.col("there")).alias("handle"), pick(handle, F.col("k")).alias("k"),
        pick(first, F.col("sum") - F.col("bytes")).alias("spent"), pick(extent, F.col("sum")).alias("total"))


def locate(batch: DataFrame, nodes: DataFrame, p: DataFrame, longest: int) -> DataFrame:
    """(seq, length, known, exit..., ) per conversation of ``batch`` (seq, length): the exit node (null: the conversation leaves at
    a node) and a depth down to which it is known to agree with it."""
    state = batch.select("seq", "length", F.lit(0).cast("long").alias("a"), F.col("length").alias("b"), F.lit(None).cast(NAME).alias("name"),
                         F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("hit"))
    for k in range(longest.bit_length() - 1, -1, -1):
        f = F.col("b") - F.col("b") % (1 << k)
        state = state.withColumn("f", F.when(f > F.col("a"), f))
        probe = state.join(p.filter(F.col("k") == k).select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("name").alias("probe")),
                           (F.col("seq") == F.col("c")) & (F.col("f") == F.col("d")), "left")
        found = nodes.filter(F.col("k") == k).select("handle", F.col("f").alias("hf"), F.col("name").alias("new_name"), F.col("depth").alias("e"),
                                                     F.col("owner").alias("new_owner"), F.col("low").alias("new_low"))
        state = probe.join(found, (F.col("probe") == F.col("handle")) & (F.col("f") == F.col("hf")), "left")
        hit, asked = F.col("e").isNotNull(), F.col("f").isNotNull()
        state = state.select(
            "seq", "length", F.when(hit, F.col("e")).otherwise(F.col("a")).alias("a"), F.when(asked & ~hit, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.when(hit, F.col("new_name")).otherwise(F.col("name")).alias("name"), F.when(hit, F.col("new_owner")).otherwise(F.col("owner")).alias("owner"),
            F.when(hit, F.col("new_low")).otherwise(F.col("low")).alias("low"), F.when(hit, F.col("f")).otherwise(F.col("hit")).alias("hit"))
    state = materialize(state, "located")
    # does the extent agree (then a child's edge may go on), or is the node itself the exit?
    here = p.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("name").alias("there"))
    checked = state.join(here, (F.col("seq") == F.col("c")) & (F.col("a") == F.col("d")), "left").drop("c", "d")
    whole = F.col("name").isNull() | F.coalesce(F.col("there") == F.col("name"), F.lit(False))
    checked = checked.withColumn("whole", whole).drop("there")
    nexts = checked.filter("whole").join(here, (F.col("seq") == F.col("c")) & (F.col("a") + 1 == F.col("d")), "left")
    edge = nodes.select("first", F.col("name").alias("exit"), F.col("depth").alias("e"), F.col("owner").alias("exit_owner"), F.col("low").alias("exit_low"))
    below = nexts.join(edge, F.col("there") == F.col("first"), "left").select(
        "seq", "length", "exit", "e", "exit_owner", "exit_low", (F.col("a") + F.col("exit").isNotNull().cast("long")).alias("known"))
    inside = checked.filter("not whole").select("seq", "length", F.col("name").alias("exit"), F.col("a").alias("e"), F.col("owner").alias("exit_owner"),
                                                F.col("low").alias("exit_low"), F.col("hit").alias("known"))
    return materialize(below.unionByName(inside), "exits")


def compared(exits: DataFrame, p: DataFrame) -> DataFrame:
    """``exits`` with ``m``: how many turns a conversation shares with the trie, its exit edge compared turn by turn."""
    open_ = exits.filter(F.col("exit").isNotNull() & (F.col("known") < F.least("length", "e")))
    mine = open_.select("seq", "exit_owner", "known", F.least("length", "e").alias("to")).join(
        p.select(F.col("conv_id").alias("seq"), "depth", "name"), "seq").filter("depth > known and depth <= to")
    theirs = p.select(F.col("conv_id").alias("exit_owner"), "depth", "name")
    agree = mine.join(theirs, ["exit_owner", "depth", "name"], "left_semi").groupBy("seq").agg(F.max("depth").alias("deep"))
    return exits.join(agree, "seq", "left").withColumn("m", F.coalesce("deep", "known")).drop("deep", "known")


def insert(batch: DataFrame, nodes: DataFrame | None, p: DataFrame, longest: int) -> DataFrame:
    """The nodes of the trie with the conversations of ``batch`` (seq, length, name) added."""
    if nodes is None:
        at = batch.select("seq", "length", F.lit(None).cast(NAME).alias("exit"), F.lit(0).cast("long").alias("e"), F.lit(None).cast("long").alias("exit_owner"),
                          F.lit(0).cast("long").alias("exit_low"), F.lit(0).cast("long").alias("m"))
    else:
        at = materialize(compared(locate(batch, nodes, p, longest), p), "compared")
    # below the exit: prefixes that no earlier conversation has
    tails = at.select("seq", "m").join(p.select(F.col("conv_id").alias("seq"), "depth", "name", "up"), "seq").filter("depth > m")
    fresh = materialize(tails.groupBy("name", "depth", "up").agg(F.min("seq").alias("owner")), "fresh")
    told = fresh.select(F.col("up").alias("name"), F.lit(1).alias("child")).unionByName(batch.select("name", F.lit(0).alias("child")))   # children and ends
    inner = told.groupBy("name").agg(F.sum("child").alias("children"), F.min("child").alias("least")).filter("children = 1 and least = 1")
    grown = fresh.join(inner, "name", "left_anti").select("name", "depth", "owner")
    starts = fresh.groupBy("owner").agg((F.min("depth") - 1).alias("base"))
    lines = grown.join(starts, "owner").select(F.concat(F.lit("new "), F.col("owner")).alias("line"), "depth", "name", "owner", "base")
    # on exit edges: a node where a conversation leaves or ends inside
    if nodes is not None:
        cuts = at.filter(F.col("exit").isNotNull() & (F.col("m") < F.col("e"))).groupBy("exit", "exit_low", "m").agg(F.min("seq").alias("seq"))
        cuts = materialize(cuts.join(p.select(F.col("conv_id").alias("seq"), F.col("depth").alias("m"), "name"), ["seq", "m"]), "cuts")
        split = cuts.select("exit").distinct().withColumn("cut", F.lit(True))
        nodes = materialize(nodes.join(split, F.col("name") == F.col("exit"), "left").drop("exit"), "marked")
        cut_nodes = nodes.filter("cut")
        line = F.concat(F.lit("edge "), F.col("exit").cast("string"))
        lines = lines.unionByName(cuts.select(line.alias("line"), F.col("m").alias("depth"), "name", F.col("seq").alias("owner"), F.col("exit_low").alias("base"))) \
                     .unionByName(cut_nodes.select(F.concat(F.lit("edge "), F.col("name").cast("string")).alias("line"), "depth", "name", "owner", F.col("low").alias("base")))
    scanned = ordered_scan(lines, ["line"], ["depth"], lag_cols=["depth"], prefix="e_")
    new = with_handles(scanned.select("name", "depth", "owner", F.coalesce("e_prev_depth", "base").alias("low")), p)
    if nodes is not None:
        new = new.unionByName(nodes.filter("cut is null").select(new.columns))
    return materialize(new, "trie")


def build(p: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """The compacted nodes below the root: name, depth (extent), owner, low, f, parent, first, handle, k, spent, total."""
    longest = distinct.agg(F.max("depth")).first()[0] or 0
    if not longest:
        return None
    todo = distinct.filter("depth > 0").select("seq", F.col("depth").alias("length"), "name")
    u, nodes, done = F.pmod(F.xxhash64("name"), F.lit(1 << 20)), None, 0.0
    for i, share in enumerate(BATCHES):
        up = done + share if i + 1 < len(BATCHES) else 1.0
        batch = todo.filter((u >= int(done * (1 << 20))) & (u < int(up * (1 << 20))))
        done = up
        if batch.head(1):
            nodes = insert(batch, nodes, p, longest)
    return nodes


# ------------------------------------------------------------------------------------------ subtrees
def subtrees(nodes: DataFrame | None, distinct: DataFrame) -> DataFrame:
    """The nodes, the root among them, with sums over their subtrees, by pointer doubling: n, all_bytes (of members), edge_bytes
    (of distinct prefixes), leaves, least; and children."""
    spark = distinct.sparkSession
    root = spark.range(1).select(root_name().alias("name"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("low"),
                                 F.lit(None).cast(NAME).alias("parent"), F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("total"))
    every = root if nodes is None else root.unionByName(nodes.select(root.columns))
    children = every.filter("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    ends = distinct.select("name", "n", "seq", (F.col("n") * F.col("total")).alias("all_bytes"))
    cur = materialize(every.join(children, "name", "left").join(ends, "name", "left").select(
        *every.columns, F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("all_bytes", F.lit(0)).cast("decimal(38,0)").alias("all_bytes"),
        (F.col("total") - F.col("spent")).cast("decimal(38,0)").alias("edge_bytes"), F.col("children").isNull().cast("long").alias("leaves"), F.col("seq").alias("least"),
        F.coalesce("n", F.lit(0)).alias("ends"), F.col("parent").alias("above")), "subtrees")
    sums = ["n", "all_bytes", "edge_bytes", "leaves"]
    while cur.filter("above is not null").head(1):
        given = cur.filter("above is not null").groupBy(F.col("above").alias("to")).agg(
            *[F.sum(c).alias(f"more_{c}") for c in sums], F.min("least").alias("more_least"))
        hops = cur.filter("above is not null").select(F.col("name").alias("via"), F.col("above").alias("next"))
        cur = materialize(cur.join(given, F.col("name") == F.col("to"), "left").join(hops, F.col("above") == F.col("via"), "left").select(
            *every.columns, "children", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).cast(cur.schema[c].dataType).alias(c) for c in sums],
            F.least("least", "more_least").alias("least"), "ends", F.col("next").alias("above")), "subtrees")
    return cur.drop("above")


def end_digests(ends: DataFrame, distinct: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the ids that end at a node, ascending, joined by commas."""
    single = distinct.filter("n = 1").select("name", F.sha2(F.col("seq").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = ends.join(distinct.filter("n > 1").select("name"), "name", "left_semi").select(F.col("name").cast("string").alias("name"), "conv_id")
    packed = many.repartitionByRange(shuffle_partitions(ends.sparkSession), "name", "conv_id").sortWithinPartitions("name", "conv_id") \
                 .mapInArrow(_pack, "name string, start long, ids string")
    return single.unionByName(stream_sha256(packed, ["name"], ["start"], "ids", ",", "ends_sha256").withColumn("name", F.col("name").cast(NAME)))


def _pack(batches):
    """Runs of one name's ids as texts of about CHUNK bytes."""
    own, start, ids, size = None, None, [], 0
    out = []
    for batch in batches:
        for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != own or size > CHUNK:
                if ids:
                    out.append({"name": own, "start": start, "ids": ",".join(ids)})
                own, start, ids, size = name, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if len(out) > 64:
            yield _texts(out)
            out = []
    if ids:
        out.append({"name": own, "start": start, "ids": ",".join(ids)})
    if out:
        yield _texts(out)


def _texts(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("start", pa.int64()), ("ids", pa.string())]))


# ------------------------------------------------------------------------------------------ all nodes
def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth, digest, bytes) over the conversations ``ids`` (conv_id).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that members share,
    over the subtree), and ``name``, the prefix's name; compacted nodes' edges are expanded to one row per depth.
    """
    p = paths(turns)
    ends, distinct = sequences(p, ids)
    t = subtrees(build(p, distinct), distinct)
    up = t.select(F.col("name").alias("parent"), F.col("least").alias("parent_least"))
    below = t.filter("depth > 0").join(up, "parent")
    piece = below.select("*", F.explode(F.sequence(F.col("low") + 1, F.col("depth"), F.lit(EDGE_PIECE))).alias("piece"))
    rows = piece.select("*", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + EDGE_PIECE - 1, F.col("depth")))).alias("at"))
    here = p.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), F.col("name").alias("own_name"), (F.col("total") - F.col("bytes")).alias("before"))
    extent = F.col("at") == F.col("depth")
    saved = (F.col("all_bytes") - F.col("n") * F.col("before")) - (F.col("edge_bytes") - (F.col("before") - F.col("spent")))
    expanded = rows.join(here, ["owner", "at"]).select(
        F.col("least").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("low") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(extent, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.col("own_name").alias("name"), (extent & (F.col("ends") > 0)).alias("ended"))
    top = t.filter("depth = 0 and n > 0").select(
        F.col("least").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("all_bytes") - F.col("edge_bytes")).cast("long").alias("saved_tokens"), "name", (F.col("ends") > 0).alias("ended"))
    every = expanded.unionByName(top)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return every.filter("ended").join(end_digests(ends, distinct), "name").drop("ended").unionByName(
        every.filter("not ended").drop("ended").withColumn("ends_sha256", none))
