"""The prefix trie against one built turn by turn, and its fat binary search against common prefixes."""
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from shopsignal.llm import prefix_trie as Z

SCHEMA = "conv_id long, turn long, role string, text string, depth string, name string, n long"


def rebuilt(rows):
    """Rows as lists of (role, text) per conversation, openings shared."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [r[3:] for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def slow(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] = saved.get(k, 0) + own
        leaves[k] = leaves.get(k) or 1
        if k:
            up = k[:-1]
            children[up] = children.get(up, 0) + 1
            saved[up] = saved.get(up, 0) + saved[k]
            leaves[up] = leaves.get(up, 0) + leaves[k]
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = Z.trie(*Z.share_openings(df))
    return {tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def odd_rows():
    rng = random.Random(5)
    rows = []
    for c in range(-7, 300):
        for t in range(rng.choice([1, 1, 2, 4, 9, 17])):
            text = rng.choice(["a", "a", "a", "b", "é\U0001F600", "", None, "x" * 3_000])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None, ""]), text))
    line = [rng.choice("ab") for _ in range(700)]
    for c, n in ((1000, 700), (1005, 650), (1010, 700), (1015, 333), (1020, 1), (1025, 699)):       # long ones that share long openings
        rows += [(c, t, "user", line[t] if t != 600 or c != 1010 else "c") for t in range(n)]
    rows += [(c, 0, "user", "the same") for c in range(2000, 2600)]                                   # copies
    rows += [(3000, 4, "user", "tie")] * 40 + [(None, 1, "user", "nobody's")]
    return [(*r, "d", "n", 7) for r in rows]


def test_every_node(spark):
    rows = odd_rows()
    want = slow(rebuilt(rows))
    got = result(spark, rows)
    assert got == want


def test_ids_at_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(Z, "CHUNK", 50)
    rows = [(c, 0, "user", "the same", "d", "n", 7) for c in range(2000, 2600, 5)]
    assert result(spark, rows) == slow(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert result(spark, []) == set()
    assert result(spark, [(None, 1, "user", "x", "d", "n", 7)]) == set()
    # 7's opening would come from 5, which is not there, and its only turn lies inside it
    assert zlib.crc32(b"7") % 9 >= 1
    rows = [(7, 1, "user", "x", "d", "n", 7)]
    assert result(spark, rows) == slow(rebuilt(rows)) == {(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())}


def test_fat_binary_search_finds_the_exit(spark):
    rng = random.Random(11)
    strings = {tuple(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))) for _ in range(120)}
    line = tuple(rng.choice("ab") for _ in range(90))
    strings |= {line[:n] for n in (20, 33, 64, 65, 90)} | {line[:n] + ("c",) * 9 for n in (19, 31, 32, 63, 88)}
    convs = dict(enumerate(sorted(strings)))
    turns = spark.createDataFrame([(c, d + 1, x, 1) for c, s in convs.items() for d, x in enumerate(s)], "conv_id long, depth long, digest string, bytes long")
    p = Z.paths(turns)
    _, distinct = Z.sequences(p, turns.select("conv_id").distinct())
    todo = distinct.select("seq", F.col("depth").alias("length"), "name")
    old, new = todo.filter("seq % 2 = 0"), todo.filter("seq % 2 = 1")
    nodes = Z.insert(old, None, p, 90)
    exits = {r.seq: r for r in Z.compared(Z.locate(new, nodes, p, 90), p).collect()}
    held = {s[:d] for c, s in convs.items() if c % 2 == 0 for d in range(len(s) + 1)}
    names = {(r.conv_id, r.depth): r.name for r in p.collect()}
    by_name = {r.name: r for r in nodes.collect()}
    assert len(exits) == sum(c % 2 for c in convs)
    for c, s in convs.items():
        if c % 2:
            deep = max(d for d in range(len(s) + 1) if s[:d] in held)
            r = exits[c]
            assert r.m == deep, s
            if r.exit is not None:
                assert by_name[r.exit].low < deep <= by_name[r.exit].depth
    # every node is filed under its two-fattest depth, and they are the compacted ones
    for r in by_name.values():
        fattest = max(range(r.low + 1, r.depth + 1), key=lambda f: f & -f)
        assert r.f == fattest and r.handle == names[r.owner, fattest] and 1 << r.k == fattest & -fattest
    ends = {s for c, s in convs.items() if c % 2 == 0}
    compact = {k for k in held if k and (k in ends or len({h for h in held if h[:-1] == k and len(h) == len(k) + 1}) > 1)}
    assert {names[next(c for c, s in convs.items() if s[:len(k)] == k), len(k)] for k in compact} == set(by_name)


def test_a_trie_takes_few_jobs(spark):
    """Each exchange and broadcast of a query is a job whose thread keeps its memory on the driver for a minute."""
    rows = [(c, t, "user", "ab"[c * t % 2], "d", "n", 7) for c in range(60) for t in range(c % 7)]
    spark.sparkContext.setJobGroup("few-jobs", "a trie")
    try:
        assert result(spark, rows) == slow(rebuilt(rows))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 125
