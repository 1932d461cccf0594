"""Repair against a plain search over all edit scripts, with conversations cut over partitions and pieces."""
import hashlib
import random
import sys
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopsignal.llm import conversation_repair as R

sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """(cost, letters) of the cheapest scripts' ASCII-least one: gone, or (initial, truncated), per row."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, last, inserts):
        out = []
        if i == len(symbols) and last in ("", "a"):
            out.append((0, ""))
        if inserts < 3:
            nxt = "a" if last == "u" else "u"
            out += [(3 + c, "I" + a) for c, a in [best(i, nxt, inserts + 1)] if c < 10**6]
        if i < len(symbols):
            out += [(4 + c, "D" + a) for c, a in [best(i + 1, last, 0)]]
            if symbols[i] != "gone":
                initial, cut = symbols[i]
                if initial in legal[last] and initial:
                    out += [(3 * cut + c, "K" + a) for c, a in [best(i + 1, initial, 0)]]
                nxt = "a" if last == "u" else "u"
                out += [(3 + 3 * cut + c, "R" + a) for c, a in [best(i + 1, nxt, 0)]]
        return min(out, default=(10**6, ""))

    return best(0, "", 0)


def numbered(symbols):
    return bytes(0 if s == "gone" else 1 + 2 * ("sua".find(s[0]) if s[0] in "sua" else 3) + s[1] for s in symbols)


SYMBOL = st.one_of(st.just("gone"), st.tuples(st.sampled_from("suax"), st.integers(0, 1)))


@settings(max_examples=400, deadline=None)
@given(st.lists(SYMBOL, max_size=13), st.integers(0, 13))
def test_block_tables_against_all_scripts(symbols, cut):
    t = R.tables()
    cost, letters = cheapest(tuple(symbols))
    data = numbered(symbols)
    assert t.write(data, 0, 0, True)[0] == letters
    codes = t.codes(data)
    v, total = 0, 0
    for code in reversed(codes):
        total += int(t.off[v, code])
        v = int(t.to[v, code])
    assert total + t.vectors[v][0] == cost
    # the same from two runs that were cut anywhere
    left, right = data[:cut], data[cut:]
    between = t.rights(t.codes(right), 0)[-1]
    first, state = t.write(left, between, 0, False)
    assert first + t.write(right, 0, state, True)[0] == letters


def slow(rows):
    """Every field of one conversation's rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        if not end:
            symbols.append("gone")
            counts["blank"] += 1
        elif (role, text) in seen:
            symbols.append("gone")
            counts["duplicate"] += 1
        else:
            symbols.append((role[:1], int(end[-1] not in ".!?")))
            counts["truncated"] += symbols[-1][1]
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(tuple(symbols))
    lines, i, last = [], 0, ""
    for letter in audit:
        if letter in "IR":
            last = "a" if last == "u" else "u"
            lines.append(("user:" if last == "u" else "assistant:") + (rows[i][2] if letter == "R" else ""))
        elif letter == "K":
            last = rows[i][1][:1]
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        i += letter != "I"
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def result(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long, _h string")
    out = R.conversations(*R.repair(df, **sizes))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    return out.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "What? \t", "é ü \U0001F600", "q" * 5_000 + ".", "a: b\nc."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts))
            for c in [None, -1, *range(40)] for t in range(rng.randrange(1, 9))]
    rows += [(100, rng.randrange(150), rng.choice(roles[:3]), f"{rng.choice(texts)}{rng.randrange(40)}{rng.choice(['.', ''])}") for _ in range(300)]
    rows += [(101, 5, "user", "again.")] * 200 + [(102, None, "assistant", "again.")] * 30 + [(103, 1, "user", " ")] * 50
    return [(*r, 1, "x") for r in rows]


def test_every_conversation_wherever_it_is_cut(spark):
    rows = odd_rows()
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t, r, x))
    want = {c: slow(v) for c, v in by.items()}
    for sizes in ({}, {"part_bytes": 900, "piece_bytes": 300}, {"part_bytes": 4_000, "piece_bytes": 1}):
        got = result(spark, rows, **sizes)
        assert len(got) == len(want)
        for r in got:
            assert tuple(r)[1:] == want[r.conv_id], (r.conv_id, sizes)


def test_pieces_follow_each_other_and_hold_whole_lines(spark):
    df = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(200)], "conv_id long, turn long, role string, text string")
    whole, parts = R.repair(df, part_bytes=1_000, piece_bytes=100)
    assert whole.count() == 0
    pieces = parts.orderBy("pid", "seq").collect()
    assert len(pieces) > 20
    assert "\n".join(p.repaired for p in pieces if p.repaired is not None) == "\n".join(f"{'user' if t % 2 == 0 else 'assistant'}:Line {t}." for t in range(200))


def test_rows_that_are_not_there_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Gone.", False), (2, 0, "user", "Here.", True)], "conv_id long, turn long, role string, text string, present boolean")
    got = {r.conv_id: (r.n_rows, r.cost, r.audit, r.repaired_sha256) for r in R.conversations(*R.repair(df, present="present")).collect()}
    assert got[1] == (0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2] == (1, 3, "KI", hashlib.sha256(b"user:Here.\nassistant:").hexdigest())
    assert R.conversations(*R.repair(df.limit(0), present="present")).count() == 0


def test_damage(spark):
    df = spark.createDataFrame([(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(5)], "conv_id long, turn long, role string, text string")
    import zlib
    got = {}
    for r in R.damage_by_hash(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for (c, t), rows in got.items():
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = {1: "", 2: "A b c"}.get(k, "A. b! c?")
        assert rows == [("user" if k == 4 else "assistant", text, k != 0)] * (2 if k == 3 else 1)
