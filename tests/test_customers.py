"""Customer scoring micro-fixtures: personas, favourite category, RFM edge cases, propensity."""
import math

from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.operators import customers, features


def test_persona_bounds(spark, make_tx):
    counts = {"c0": 0, "c1": 1, "c2": 2, "c3": 3, "c15": 15, "c16": 16}
    clients = spark.createDataFrame([(c, "LOYAL", "X") for c in counts], "ClientID string, ClientSegment string, ClientCountry string")
    rows = [{"ClientID": c} for c, n in counts.items() for _ in range(n)]
    got = {r.ClientID: r.Persona for r in customers.personas(clients, make_tx(rows)).collect()}
    assert got == {"c0": K.NO_TRANSACTIONS, "c1": K.LOYAL_LOW, "c2": K.LOYAL_LOW, "c3": K.LOYAL_MID,
                   "c15": K.LOYAL_MID, "c16": K.VERY_FREQUENT}


def test_persona_segments(spark, make_tx):
    clients = spark.createDataFrame([("a", "inactive_1y"), ("b", "PROSPECT"), ("c", "TOP")], "ClientID string, ClientSegment string")
    rows = [{"ClientID": c} for c in "abc" for _ in range(3)]
    got = {r.ClientID: r.Persona for r in customers.personas(clients, make_tx(rows)).collect()}
    assert got == {"a": K.INACTIVE_MID, "b": K.OTHER_ACTIVE, "c": K.LOYAL_MID}


def test_favorite_category_tie_and_null(spark):
    df = spark.createDataFrame([("c1", "b", 1.0), ("c1", "a", 1.0), ("c2", None, 5.0)],
                               "ClientID string, Category string, SalesNetAmountEuro double")
    fav = customers.favorite_category(df)
    assert {r.ClientID: r.FavoriteCategory for r in fav.collect()} == {"c1": "a"}
    flags = customers.add_favorite_flags(df, fav).filter("ClientID = 'c2'").first()
    assert (flags.FavoriteCategory, flags.IsFavoriteCategory, flags.IsCrossSellOpportunity) == (None, 0, 1)


def test_single_order_volatility_is_zero(make_tx):
    m = features.add_calendar(make_tx([{"ClientID": "solo"}, {"ClientID": "x"}, {"ClientID": "x", "amount": "30"}]))
    rfm = {r.ClientID: r for r in customers.customer_rfm(m).collect()}
    assert rfm["solo"].PriceVolatility == 0.0 and rfm["x"].PriceVolatility > 0
    assert all(3 <= r.RFM_Score <= 15 for r in rfm.values())


def test_propensity_recency_factor(spark):
    df = spark.createDataFrame([(0, 0.0), (5, 0.0)], "DaysSinceLastPurchase int, AffinityScore double")
    got = sorted(r.PropensityScore for r in customers.propensity(df).collect())
    assert math.isclose(got[1], 0.5 / math.log(2)) and math.isclose(got[0], 0.5 / math.log(7))


def test_share_of_wallet_sums_to_one(make_tx, spark):
    rows = [{"ClientID": "c", "ProductID": p, "amount": a} for p, a in [("p1", "10"), ("p2", "30"), ("p1", "20")]]
    m = make_tx(rows).join(spark.createDataFrame([("p1", "F1"), ("p2", "F2")], "ProductID string, FamilyLevel1 string"), "ProductID")
    aff = customers.affinity_matrix(m)
    assert math.isclose(aff.agg(F.sum("ShareOfWallet")).first()[0], 1.0)
    top = aff.orderBy(F.desc("AffinityScore")).first()
    assert top.FamilyLevel1 == "F1"          # .7·0.5 + .3·2/2 beats .7·0.5 + .3·1/2


def test_persona_enriched_mode_tie_and_prospect_fills(spark, make_tx):
    clients = spark.createDataFrame([("c1", "LOYAL"), ("new", "TOP")], "ClientID string, ClientSegment string")
    rows = [{"ClientID": "c1", "ProductID": p, "date": f"2024-01-0{i + 1} 00:00:00"} for i, p in enumerate(["pb", "pa", "pb", "pa"])]
    tx = make_tx(rows)
    cats = spark.createDataFrame([("pa", "A"), ("pb", "B")], "ProductID string, Category string")
    master = tx.join(cats, "ProductID", "left")
    enr = {r.ClientID: r for r in customers.persona_enriched(customers.personas(clients, tx), master).collect()}
    assert enr["c1"].FavoriteCategory == "A"                # 2 vs 2: smallest wins
    assert enr["c1"].AvgOrderValue == 10.0 and enr["c1"].Recency == 0
    assert (enr["new"].TotalSpent, enr["new"].Recency, enr["new"].FavoriteCategory, enr["new"].AvgOrderValue) == (0.0, 999, "None", None)


def test_buyer_without_any_category_reads_na(spark, make_tx):
    clients = spark.createDataFrame([("a", "LOYAL", "C"), ("b", "LOYAL", "C")], "ClientID string, ClientSegment string, ClientCountry string")
    tx = make_tx([{"ClientID": "a"}])
    master = tx.selectExpr("*", "CAST(NULL AS string) AS Category")
    got = {r.ClientID: r.FavoriteCategory for r in customers.persona_enriched(customers.personas(clients, tx), master).collect()}
    assert got == {"a": "N/A", "b": "None"}
