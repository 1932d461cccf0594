"""Rules, Markov transitions, trends, waterfall and cosine top-k."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from shopsignal.operators import baskets, products, sequences


def test_rules_fixture(make_tx):
    rows = []
    for b, items in {"B1": "ab", "B2": "ab", "B3": "ac", "B4": "a"}.items():
        rows += [{"BasketID": b, "ProductID": i} for i in items]
    rules = {(r.antecedent, r.consequent): r for r in baskets.association_rules(make_tx(rows), "ProductID").collect()}
    ab, ba = rules[("a", "b")], rules[("b", "a")]
    assert ab.pair_count == 2 and abs(ab.support - 2 / 3) < 1e-12 and abs(ab.confidence - 2 / 3) < 1e-12
    assert abs(ab.lift - 1.0) < 1e-12 and abs(ba.confidence - 1.0) < 1e-12 and abs(ba.lift - 1.0) < 1e-12


def test_big_basket_block_split_matches_brute_force(make_tx, monkeypatch):
    monkeypatch.setattr(baskets, "PAIR_BLOCK", 7)       # force many blocks for a 40-item basket
    items = [f"i{k}" for k in range(40)]
    rows = [{"BasketID": "big", "ProductID": i} for i in items] + [{"BasketID": "s", "ProductID": "i1"}, {"BasketID": "s", "ProductID": "i2"}]
    rules = baskets.association_rules(make_tx(rows), "ProductID", min_count=1)
    assert rules.count() == 40 * 39
    assert rules.filter("antecedent = 'i1' AND consequent = 'i2'").first().pair_count == 2


def test_pattern_growth_finds_the_same_rules(make_tx):
    import random
    rng = random.Random(6)
    rows = [{"BasketID": f"b{b}", "ProductID": f"p{min(rng.randrange(12), rng.randrange(12))}", "qty": 1} for b in range(120) for _ in range(rng.randrange(1, 6))]
    rows += [{"BasketID": "b0", "ProductID": None}, {"BasketID": "alone", "ProductID": "p1"}]
    tx = make_tx(rows)
    for limit in ({"min_count": 1}, {"min_count": 2}, {"min_count": 7}, {"min_support": 0.05}, {"min_count": 10**6}):
        want = {(r.antecedent, r.consequent): (r.pair_count, round(r.support, 12), round(r.confidence, 12), round(r.lift, 12))
                for r in baskets.association_rules(tx, "ProductID", **limit).collect()}
        got = {(r.antecedent, r.consequent): (r.pair_count, round(r.support, 12), round(r.confidence, 12), round(r.lift, 12))
               for r in baskets.rules_by_pattern_growth(tx, "ProductID", **limit).collect()}
        assert got == want, limit
        assert bool(want) == (limit != {"min_count": 10**6})
    assert baskets.rules_by_pattern_growth(tx.limit(0), "ProductID", min_count=2).count() == 0


def test_markov_self_loops_skipped(make_tx, spark):
    rows = [{"ClientID": "c", "date": f"2024-01-0{d} 00:00:00", "ProductID": f"p{d}"} for d in range(1, 5)]
    fam = spark.createDataFrame([("p1", "x"), ("p2", "x"), ("p3", "y"), ("p4", "x")], "ProductID string, FamilyLevel2 string")
    m = make_tx(rows).join(fam, "ProductID").withColumn("StoreCountry", F.lit("C"))
    got = {(r.State, r.NextState): r.prob for r in sequences.markov_transitions(m).collect()}
    assert got == {("x", "y"): 1.0, ("y", "x"): 1.0}


def test_trend_weights(make_tx, spark):
    rows = [{"date": "2024-03-31 00:00:00", "ProductID": "p", "amount": "10"},
            {"date": "2024-03-21 00:00:00", "ProductID": "p", "amount": "10"}]
    m = make_tx(rows).withColumn("StoreCountry", F.lit("C")).withColumn("FamilyLevel1", F.lit("F"))
    s = products.trending_scores(m, dt.datetime(2024, 3, 31), filtered=m.withColumn("PricePerUnit", F.lit(10.0))).first()
    assert abs(s.recent_score - 1.5) < 1e-12          # 1/(1+0) + 1/(1+10·0.1)


def test_waterfall_threshold(spark):
    rows = [("s1", "C", "p1", "F1", 9.99), ("s2", "C", "p2", "F2", 0.01)]
    scores = spark.createDataFrame(rows, "StoreID string, StoreCountry string, ProductID string, FamilyLevel1 string, FinalScore double") \
        .withColumn("PricePerUnit", F.lit(1.0))
    stores = spark.createDataFrame([("s1", "C")], "StoreID string, StoreCountry string")
    out = products.store_trending_recs(scores, stores).collect()
    assert {r.Source for r in out} == {"Country Level"} and [r.ProductID for r in sorted(out, key=lambda r: r.Rank)] == ["p1", "p2"]


def test_cosine_topk_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    got = sequences.cosine_topk(df, "vec_id", "embedding", k=3, blocks=3).toPandas()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    for i in range(60):
        exp = list(np.argsort(-sims[i])[:3])
        row = got[got.vec_id == str(i)].sort_values("Rank")
        assert [int(x) for x in row.neighbor_vec_id] == exp


def test_cosine_ties_do_not_depend_on_blocks(spark):
    """Thirty near-equal vectors and a NULL one: the smallest ids win for any number of blocks."""
    rows = [(f"{i:03d}", [1.0, 1e-9 * (30 - i)]) for i in range(30)] + [("x", None)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    for blocks, query_blocks in ((1, 1), (7, 1), (3, 5)):
        got = sequences.cosine_topk(df, "vec_id", "embedding", k=3, blocks=blocks, query_blocks=query_blocks)
        own = {r.neighbor_vec_id: r.Rank for r in got.filter("vec_id = '010'").collect()}
        assert own == {"000": 1, "001": 2, "002": 3}


def test_big_basket_is_paired_across_blocks(spark, monkeypatch):
    from shopsignal.operators import baskets
    monkeypatch.setattr(baskets, "PAIR_BLOCK", 3)
    rows = [("b1", str(i)) for i in range(11)] + [("b2", "1"), ("b2", "2"), ("b3", "2"), ("b3", "1")]
    df = spark.createDataFrame(rows, "BasketID string, ProductID string")
    got = {(r.antecedent, r.consequent): r.pair_count for r in baskets.association_rules(df, "ProductID", min_count=1).collect()}
    assert len(got) == 110 and got["1", "2"] == 3 == got["2", "1"] and got["3", "4"] == 1


def test_trend_keeps_the_whole_target_day(spark, make_tx):
    from shopsignal.operators import products
    df = make_tx([{"date": "2024-03-10 15:00:00"}, {"date": "2024-03-11 00:00:00", "ProductID": "late"}, {"date": "2024-03-09 00:00:00"}])
    df = df.selectExpr("*", "'F' AS FamilyLevel1", "'X' AS StoreCountry", "1.0D AS PricePerUnit")
    got = {r.ProductID: r.recent_score for r in products.trending_scores(df, "2024-03-10", filtered=df).collect()}
    # 9 hours after the target counts as day -1 (elapsed days are floored): 1 / 0.9
    assert set(got) == {"p1"} and abs(got["p1"] - (1 / 0.9 + 1 / 1.1)) < 1e-12
