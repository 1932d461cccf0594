"""Sketched quantiles: measured rank errors, merging, and the scores that use them."""
import random

from pyspark.sql import functions as F

from shopsignal.operators import numeric, products, sketches

PS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.8, 0.9, 0.99, 1.0]


def skewed(spark, n=60_000):
    rng = random.Random(9)
    return spark.createDataFrame([(i % 7, rng.lognormvariate(3, 2), float(rng.choice([1, 1, 1, 2, 3, 50]))) for i in range(n)], "g int, x double, q double").cache()


def test_rank_errors_are_under_the_bound(spark):
    df = skewed(spark)
    found = {c: dict(zip(PS, v)) for c, v in sketches.approx_quantiles(df, {"x": PS, "q": PS}).items()}
    for r in sketches.measured_rank_errors(df, found).collect():
        assert r.Rows == 60_000 and r.RankError <= 2 * sketches.rank_error(), (r.Column, r.P, r.RankError)
    ends = df.agg(F.min("x"), F.max("x")).first()
    assert (found["x"][0.0], found["x"][1.0]) == tuple(ends)
    assert sketches.rank_error(200) < 0.0134 and sketches.rank_error() < 0.0036


def test_merged_sketches_answer_for_unions(spark):
    df = skewed(spark)
    parts = sketches.sketches(df, ["g"], ["x"])
    some = sketches.merged(parts.filter("g < 3"), [], ["x"]).select(sketches.quantiles("x", PS).alias("x")).first()["x"]
    for r in sketches.measured_rank_errors(df.filter("g < 3"), {"x": dict(zip(PS, some))}).collect():
        assert r.RankError <= 2 * sketches.rank_error()


def test_small_tables_are_exact_values_and_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (9.0, None)], "x double, y double")
    assert sketches.approx_quantiles(df, {"x": [0, 0.5, 1], "y": [0.5]}) == {"x": [1.0, 2.0, 9.0], "y": [None]}
    assert sketches.approx_quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_approximate_scores_and_tiers(spark):
    """Only values within the error of an edge may land on its other side."""
    df = skewed(spark).withColumn("id", F.monotonically_increasing_id())
    exact = numeric.quintile_scores(df, {"x": ("s", True)}).select("id", "s")
    near = numeric.quintile_scores(df, {"x": ("t", True)}, quantiles=sketches.approx_quantiles).select("id", "t")
    off = exact.join(near, "id").filter("s <> t").count()
    assert off <= 4 * 2 * sketches.rank_error() * 60_000
    pf = df.select(F.col("x").alias("ProductTotalRevenue"), F.col("x").alias("ProductSalesVelocity"))
    top = products.product_tiers(pf, quantiles=sketches.approx_quantiles).agg(F.avg("IsTopProduct")).first()[0]
    assert abs(top - 0.2) <= 2 * sketches.rank_error()
