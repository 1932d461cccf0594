"""Distributed kernels against brute force: ordered scan, quintiles, quantiles, top-k."""
import random

import pandas as pd
from pyspark.sql import functions as F

from shopsignal.operators.numeric import exact_quantiles, grouped_quantile, ordered_scan, quintile_scores, top_k


def _scores(spark, values, asc=True):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "ClientID string, x double")
    out = quintile_scores(df, {"x": ("s", asc)}).orderBy(F.col("ClientID").cast("int"))
    return [r.s for r in out.collect()]


def test_quintile_distinct_edges(spark):
    assert _scores(spark, range(1, 11)) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_quintile_duplicate_edges_falls_back_to_average_rank(spark):
    assert _scores(spark, [1, 1, 1, 1, 2, 3]) == [3, 3, 3, 3, 5, 5]


def test_quintile_descending(spark):
    assert _scores(spark, [1, 1, 1, 1, 2, 3], asc=False) == [3, 3, 3, 3, 1, 1]
    assert _scores(spark, range(1, 11), asc=False) == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]


def test_quintile_random_values_by_average_rank(spark):
    """Two thirds of the values are 0, so edges repeat: a score is 1 + the fifths below the rank share."""
    rnd = random.Random(7)
    vals = [rnd.choice([0, 0, rnd.randint(1, 30)]) for _ in range(300)]
    order = sorted(vals)
    shares = [(order.index(v) + (order.count(v) + 1) / 2) / len(vals) for v in vals]
    assert _scores(spark, vals) == [1 + sum(share > k / 5 for k in (1, 2, 3, 4)) for share in shares]


def test_quintile_several_columns_in_one_scan(spark):
    df = spark.createDataFrame([(float(i), float(-i), 1.0 if i < 8 else float(i)) for i in range(1, 11)], "a double, b double, c double")
    out = quintile_scores(df, {"a": ("sa", True), "b": ("sb", False), "c": ("sc", True)}).orderBy("a").collect()
    assert [r.sa for r in out] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] == [r.sb for r in out]
    assert [r.sc for r in out] == [2] * 7 + [4, 5, 5]          # the seven share rank 4 of 10: 0.4 is not above 0.4


def test_exact_quantile_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "v double")
    assert exact_quantiles(df, {"v": [0.8]})["v"] == [float(pd.Series([1.0, 2, 3, 4]).quantile(0.8))]   # 3.4 (linear)
    vals = [random.Random(3).random() * 100 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df.withColumn("w", F.lit(None).cast("double")), {"v": [0.1, 0.5, 0.99], "w": [0.5]})
    assert got.pop("w") == [None]
    got = got["v"]
    exp = pd.Series(vals).quantile([0.1, 0.5, 0.99]).tolist()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, exp))


def test_ordered_scan_hot_key_across_partitions(spark):
    """A key holding most rows is split over partitions; numbers, sums and lags stay exact."""
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 20)}", i, rnd.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = ordered_scan(df, ["k"], ["o"], sum_col="v", lag_cols=["v"], num_partitions=16).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["k", "o"])
    pdf["rn"] = pdf.groupby("k").cumcount() + 1
    pdf["cum"] = pdf.groupby("k")["v"].cumsum()
    pdf["prev_v"] = pdf.groupby("k")["v"].shift(1)
    m = got.merge(pdf, on=["k", "o"], suffixes=("", "_exp"))
    assert len(m) == len(rows)
    assert (m.rn == m.rn_exp).all() and (m.cum == m.cum_exp).all()
    assert ((m.prev_v == m.prev_v_exp) | (m.prev_v.isna() & m.prev_v_exp.isna())).all()


def test_ordered_scan_global_running_sum(spark):
    rows = [(i, (i * 37) % 11) for i in range(1000)]
    df = spark.createDataFrame(rows, "o int, v int")
    got = ordered_scan(df, [], [F.col("o").desc()], sum_col="v", num_partitions=7).toPandas().sort_values("o", ascending=False)
    assert got["cum"].tolist() == pd.Series([v for _, v in sorted(rows, reverse=True)]).cumsum().tolist()


def test_top_k_equals_window_rank(spark):
    rnd = random.Random(5)
    rows = [("g" + str(rnd.randint(0, 3)), i, rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, id int, score int")
    got = top_k(df, ["g"], [F.col("score").desc(), F.col("id")], 5).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "id", "score"]).sort_values(["g", "score", "id"], ascending=[True, False, True])
    exp = pdf.groupby("g").head(5)
    assert sorted(zip(got.g, got.id)) == sorted(zip(exp.g, exp.id))


def test_top_k_without_keys(spark):
    df = spark.createDataFrame([(i, (i * 7) % 10) for i in range(100)], "id int, score int")
    got = top_k(df, [], [F.col("score").desc(), F.col("id")], 3).orderBy("Rank").collect()
    assert [(r.id, r.Rank) for r in got] == [(7, 1), (17, 2), (27, 3)]


def test_grouped_quantile_with_a_hot_group(spark):
    rnd = random.Random(11)
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 3)}", float(rnd.randint(0, 400))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double")
    exp = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].quantile(0.5).to_dict()
    assert {r.g: r.m for r in grouped_quantile(df, ["g"], "v", 0.5, "m").collect()} == exp


def test_pareto_running_sum_matches_sorted_cumsum(spark, make_tx):
    from shopsignal.operators.features import add_pareto
    rnd = random.Random(9)
    amounts = [rnd.choice(["5.00", "7.25", "7.25", "100.10", "3.33"]) for _ in range(300)]
    got = add_pareto(make_tx([{"amount": a, "BasketID": f"{i:04d}"} for i, a in enumerate(amounts)])).toPandas()
    got = got.sort_values(["SalesNetAmountEuro", "BasketID"], ascending=[False, True])
    assert got["CumulativeRevenue"].tolist() == got["SalesNetAmountEuro"].cumsum().tolist()


def test_ordered_scan_sums_several_columns(spark):
    from shopsignal.operators.numeric import ordered_scan
    rows = [(g, i, i % 3, 10 * i) for g in ("a", "b") for i in range(200 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, i int, x long, y long")
    got = {(r.g, r.i): (r.s_rn, r.s_cum_x, r.s_cum_y) for r in ordered_scan(df, ["g"], ["i"], sum_col=["x", "y"], num_partitions=7, prefix="s_").collect()}
    for g, n in (("a", 200), ("b", 3)):
        x = y = 0
        for i in range(n):
            x, y = x + i % 3, y + 10 * i
            assert got[g, i] == (i + 1, x, y)
