import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsignal.llm.knn_join import top_inner_products


def slow(rows, asks, k):
    vecs = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in vecs:
        if asks(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs if i != q and len(a) == len(b))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block,query_block,pivots", [(20_000, 2_000, 16), (37, 5, 4)])
def test_random_and_hot_vectors(spark, block, query_block, pivots):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]                     # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_inner_products(df, F.pmod("vec_id", F.lit(10)) == 0, k=5, block=block, query_block=query_block, pivots=pivots)
    assert {tuple(r) for r in got.collect()} == slow(rows, lambda i: i % 10 == 0, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (10, [0.5, 0.5]), (20, None), (30, [None, 1.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 0.0]), (None, [1.0, 1.0]),
            (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 2.0]), (5, [1.0]), (60, [2.0]), (6, []), (70, []), (80, [1e8, -1e8]), (81, [1e6, 3.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = {tuple(r) for r in top_inner_products(df, F.pmod("vec_id", F.lit(10)) == 0, k=5).collect()}
    assert got == slow(rows, lambda i: i % 10 == 0, 5)
    assert top_inner_products(df.limit(0), F.lit(True)).count() == 0
    assert top_inner_products(df, F.lit(False)).count() == 0


def test_knn_id_with_several_vectors(spark):
    """An id's own rows fill the nearest places of its query; the others are far."""
    own = [(0, [10.0, 0.01 * i]) for i in range(12)]
    others = [(i, [-9.0 + 0.01 * i, 1.0]) for i in range(1, 15)] + [(100 + i, [0.0, -9.0 + 0.01 * i]) for i in range(14)]
    rows = own + others
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = top_inner_products(df, F.col("vec_id") == 0, k=3).collect()
    got = [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    scores = {(j, a[0] * b[0] + a[1] * b[1]) for i, a in ints if i == 0 for j, b in ints if j != 0}
    assert got == sorted(scores, key=lambda x: (-x[1], x[0]))[:3]


def clustered(n, clusters, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dim))
    return [(i, [float(x) for x in centres[i % clusters] + rng.normal(0, spread, dim)]) for i in range(n)]


def test_clusters_are_pruned_and_noise_is_sent_once(spark):
    asks = F.pmod("vec_id", F.lit(10)) == 0
    rows = clustered(3_000, 12, 16, 0.05, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    report = {}
    got = {tuple(r) for r in top_inner_products(df, asks, k=5, query_block=50, report=report).collect()}
    assert got == slow(rows, lambda i: i % 10 == 0, 5)
    assert report["rows"] == 3_000 and report["wide"] == 0
    assert report["copies"] < report["cells"] * 3_000 / 3          # under a third of pivots times rows
    rng = np.random.default_rng(4)
    noise = [(i, [float(x) for x in rng.normal(0, 1, 64)]) for i in range(1_000)]
    df, report = spark.createDataFrame(noise, "vec_id long, embedding array<double>"), {}
    got = {tuple(r) for r in top_inner_products(df, asks, k=5, report=report).collect()}
    assert got == slow(noise, lambda i: i % 10 == 0, 5)
    assert report["copies"] <= 1_000 * 1.2 and report["queries"] <= 120      # every row to one group


def test_narrow_and_wide_cells_together(spark):
    """A tight far cluster is narrow, the rest is noise; blocks of a few rows."""
    rng = np.random.default_rng(6)
    rows = [(i, [100.0 + float(x) for x in rng.normal(0, 0.001, 6)]) for i in range(200)] + [(1000 + i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_inner_products(df, F.pmod("vec_id", F.lit(7)) == 0, k=4, pivots=9, block=23, query_block=4).collect()}
    assert got == slow(rows, lambda i: i % 7 == 0, 4)


def test_large_numbers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 40, 2 ** 40, 3)]) for i in range(120)]      # scores beyond exact doubles
    rows = [(i, [x / 256 / 2 ** 12 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_inner_products(df, F.pmod("vec_id", F.lit(5)) == 0, k=6, pivots=8, block=11).collect()}
    assert got == slow(rows, lambda i: i % 5 == 0, 6)
