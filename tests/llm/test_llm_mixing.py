import math
from collections import defaultdict
from fractions import Fraction

import pytest
from helpers import odd_docs
from pyspark.sql import functions as F

from shopsignal.llm.mixing import mix, mixed_documents, source_targets
from shopsignal.llm.queries import op2_source_mix

SF = "/root/testdata/sf0.001"


def slow_targets(sizes):
    """Share out by weight again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while free:
        all_w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / all_w >= 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / all_w for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
            free.discard(s)
        left -= sum(out[s] for s in over)
    return out


def test_targets_and_exact_budgets(spark):
    rows = op2_source_mix(spark, SF).collect()
    again = op2_source_mix(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = slow_targets(size)
    for r in rows:
        assert r.target == pytest.approx(float(want[source[r.doc_id]]), rel=1e-12) and r.source_size == size[source[r.doc_id]]
    assert {s: math.floor(t) for s, t in want.items()} == dict(taken)


def test_targets_of_as_many_words_as_six_gigabytes_hold(spark):
    """Totals below 2^31 whose multiples are above it, and totals above it."""
    for times in (1, 40):
        sizes = {f"s{i}": (60_000_000 + 7 * i) * times for i in range(20)} | {None: 500_000_000 * times}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        want = slow_targets(sizes)
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), rel=1e-12) for s in want)


def test_odd_rows_and_the_mix_itself(spark):
    df = odd_docs(spark, "taken")
    slim = mix(df).collect()
    assert len(slim) == df.count()
    for r in slim:
        assert 0 <= r.taken <= 2 * r.size
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len((r.text or "").encode().split())
    taken = defaultdict(int)
    for r in slim:
        taken[r.source] += r.taken
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}
    assert mix(df.limit(0)).count() == 0 and mixed_documents(df.limit(0)).count() == 0


def test_repeated_rows_share_a_cut(spark):
    rows = [(1, "a b c d", "x")] * 5 + [(2, "a b", "y"), (3, None, "z"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(r.taken for r in mix(df).collect())
    assert sum(len((r.text or "").split()) for r in mixed_documents(df).collect()) == total


def test_main_path_is_native(spark):
    plan = mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_a_repeated_row_is_numbered_by_many_tasks(spark):
    """A third of the table is one row; rows that differ only in another column are told apart, and reruns agree."""
    rows = [(i, f"w{i} of the text", "a" if i % 2 else "b", i) for i in range(400)] + [(7, "one row again and again", "a", 0)] * 200 \
        + [(9, "same id and text", "b", k) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(8)
    out = mixed_documents(df)
    assert out.columns == df.columns
    got, again = sorted(map(tuple, out.collect())), sorted(map(tuple, mixed_documents(df.repartition(5)).collect()))
    assert got == again
    taken = mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    words = defaultdict(int)
    for _, text, source, _ in got:
        words[source] += len(text.split())
    assert {r.source: r.n for r in taken} == dict(words)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_task" in plan
