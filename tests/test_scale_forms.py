"""Forms that only matter at size: slim ordered scans, defined dimension rows, campaigns, bounded columns, options."""
import re

import pytest
from pyspark.sql import functions as F

from shopsignal.functions.scalar import black_friday
from shopsignal.operators import bi, customers, features, recommend
from shopsignal.operators.features import DATE
from shopsignal.plans.catalog import build_query

SF = "/root/testdata/sf0.001"


def checkpointed(df) -> list[set[str]]:
    """Columns of each checkpointed scan in a plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return [set(re.findall(r"(\w+)#\d+", line.split("[", 1)[1])) for line in text.splitlines() if "LogicalRDD" in line]


def test_ordered_scans_write_the_row_key_alone(spark, make_tx):
    key = {"BasketID", "LineNo", "ClientID", "ProductID", "StoreID", "SalesNetAmountEuro", "Quantity", DATE, "_scan_pid"}
    scans = checkpointed(build_query("days_since_last", spark, SF))
    assert scans and all(s <= key for s in scans)
    wide = make_tx([{"ClientID": c, "date": f"2024-01-{d:02d} 00:00:00", "ProductID": p} for c in ("a", None) for d, p in ((1, "p"), (3, "q"), (3, None))])
    wide = wide.withColumn("Extra", F.concat_ws("-", "ClientID", "ProductID"))
    out = features.add_by_row_key(wide, lambda r: features.add_pareto(features.add_days_since_last(r)))
    assert out.columns[:len(wide.columns)] == wide.columns and out.count() == 6
    got = {(r.ClientID, r.ProductID): r.DaysSinceLastPurchase for r in out.collect()}
    assert got[("a", "p")] == 9999 and got[(None, "q")] == 9999 and {got[("a", "q")], got[("a", None)]} == {2, 0}
    assert all("Extra" not in s for s in checkpointed(features.add_days_since_last(wide)))


def test_a_repeated_dimension_key_keeps_one_defined_row(spark, make_tx):
    tx = make_tx([{"ProductID": "p1"}, {"ProductID": "p2", "ClientID": "c9"}])
    products = [("p1", "B", "F", "G", "U"), ("p1", "A", None, "Z", "U"), ("p1", "A", "X", "Z", "U"), ("p2", None, "F", "G", "U"), ("p2", "A", "F", "G", "U")]
    clients = spark.createDataFrame([("c1", "S", "FRA", "F", 1, 0, 1), ("c1", "S", "DEU", "F", 1, 0, 1)],
                                    "ClientID string, ClientSegment string, ClientCountry string, ClientGender string, HasEmail int, HasPhone int, HasContact int")
    stores = spark.createDataFrame([("s1", "ITA"), ("s1", "ESP")], "StoreID string, StoreCountry string")
    for rows in (products, products[::-1]):
        df = spark.createDataFrame(rows, "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string, Universe string").repartition(3)
        got = {r.ProductID: r for r in features.master_join(tx, df, clients, stores).collect()}
        assert len(got) == 2 and got["p1"].ClientCountry == "DEU" and got["p1"].StoreCountry == "ESP"
        assert (got["p1"].Category, got["p1"].FamilyLevel1) == ("A", None) and got["p2"].Category is None and got["p2"].ClientCountry is None


def test_campaigns_are_the_heads_of_the_whole_lists(spark, make_tx, monkeypatch):
    import random
    rng = random.Random(8)
    rows = [{"ClientID": f"c{rng.randrange(60)}", "ProductID": f"p{min(rng.randrange(8), rng.randrange(8))}", "amount": str(rng.randrange(1, 9)),
             "date": f"2024-01-{rng.randrange(1, 28):02d} 00:00:00"} for _ in range(500)]
    products = spark.createDataFrame([(f"p{i}", f"f{i % 3}") for i in range(9)], "ProductID string, FamilyLevel1 string")
    m = make_tx(rows).join(products, "ProductID")
    monkeypatch.setattr(customers, "CAMPAIGN_BLOCK", 7)
    full = {}
    for r in customers.propensity_cross_sell(m, products, products).collect():
        full.setdefault(r.ProductID, []).append((-round(r.PropensityScore, 6), r.ClientID))
    for n in (1, 5, 1_000):
        got = {}
        for r in customers.cross_sell_campaign(m, products, products, per_target=n).orderBy("ProductID", "Rank").collect():
            got.setdefault(r.ProductID, []).append((-round(r.PropensityScore, 6), r.ClientID))
        assert got == {p: sorted(v)[:n] for p, v in full.items()}


def test_more_countries_than_columns_are_an_error(spark, monkeypatch):
    stocks = spark.createDataFrame([(f"C{i}",) for i in range(6)] + [(None,)], "StoreCountry string")
    assert bi.country_columns(stocks) == [f"C{i}" for i in range(6)]
    monkeypatch.setattr(bi, "MAX_COUNTRIES", 5)
    with pytest.raises(ValueError, match="long form"):
        bi.country_columns(stocks)


def test_black_friday_after_thanksgiving(spark):
    years = spark.createDataFrame([(2018,), (2019,), (2023,), (2024,)], "y int")
    got = [(str(r[0]), str(r[1])) for r in years.orderBy("y").select(black_friday("y"), black_friday("y", us_thanksgiving=True)).collect()]
    assert got == [("2018-11-23", "2018-11-23"), ("2019-11-22", "2019-11-29"), ("2023-11-24", "2023-11-24"), ("2024-11-22", "2024-11-29")]


def test_strict_blend_and_short_rule_lists(spark):
    ctx = spark.createDataFrame([("c", "X Mid Freq", "blend", "p0", "fam", "FRA", "FRA")],
                                "ClientID string, Persona string, Route string, LastProductID string, LastFamilyLevel2 string, LastClientCountry string, Region string")
    rules = spark.createDataFrame([("p0", f"r{i:02d}", 3, 0.1, 0.5, float(50 - i)) for i in range(30)], "antecedent string, consequent string, pair_count long, support double, confidence double, lift double")
    regions = spark.createDataFrame([("FRA", f"r{i:02d}") for i in range(3, 30)] + [("FRA", "m1")], "Region string, ProductID string")
    markov = spark.createDataFrame([("FRA", "fam", "next", 5, 1.0, 1)], "Country string, State string, NextState string, n long, prob double, Rank int")
    popular = spark.createDataFrame([("m1", 1.0, "next", 1)], "ProductID string, FinalScore double, FamilyLevel2 string, Rank int")
    loose = [(r.pos, r.ProductID) for r in recommend.blend_primary(ctx, None, markov, popular, rules, regions).orderBy("pos").collect()]
    assert loose == [(11, "m1"), (12, "r03"), (22, "r04"), (32, "r05"), (42, "r06"), (52, "r07")]       # five stocked rules, renumbered
    strict = [r.ProductID for r in recommend.blend_primary(ctx, None, markov, popular, rules, regions, strict=True).orderBy("pos").collect()]
    assert strict == ["r03", "r04", "r05", "r06", "r07"]
