"""Recommendation ranking: backfill, interleave, stock filter, routing."""
import datetime as dt

from shopsignal.operators import recommend


def _ctx(spark, persona="Loyal/Top (Mid Freq)"):
    return spark.createDataFrame(
        [("c1", persona, "L", "FL", "C", dt.datetime(2024, 1, 1))],
        "ClientID string, Persona string, LastProductID string, LastFamilyLevel2 string, "
        "LastClientCountry string, LastDate timestamp_ntz")


def _stocks(spark, items, country="C"):
    return spark.createDataFrame([(country, p, 5) for p in items], "StoreCountry string, ProductID string, Quantity int")


def test_backfill_first_wins(spark):
    persona = spark.createDataFrame([("c1", "Loyal/Top (Low Freq)")], "ClientID string, Persona string")
    last = _ctx(spark).drop("Persona")
    popular = spark.createDataFrame([("1", 1, "F"), ("2", 2, "F"), ("3", 3, "F")], "ProductID string, Rank int, FamilyLevel2 string")
    rules = spark.createDataFrame([("L", "1", 2.0)], "antecedent string, consequent string, lift double")
    recs = recommend.recommendations(persona, last, popular, popular.limit(0), rules, _stocks(spark, "123"), top_n=2)
    assert [r.ProductID for r in recs.orderBy("Rank").collect()] == ["1", "2"]


def test_interleave_blend(spark):
    ctx = recommend.client_context(_ctx(spark).select("ClientID", "Persona"), _ctx(spark).drop("Persona"))
    similar = spark.createDataFrame([("L", "1", 0.9, 1), ("L", "2", 0.8, 2)], "ProductID string, SimilarProductID string, similarity double, Rank int")
    markov = spark.createDataFrame([("C", "FL", "F3", 1.0, 1)], "Country string, State string, NextState string, prob double, Rank int")
    popular = spark.createDataFrame([("3", 1, "F3")], "ProductID string, Rank int, FamilyLevel2 string")
    rules = spark.createDataFrame([("L", "1", 2.0), ("L", "4", 1.0)], "antecedent string, consequent string, lift double")
    recs = recommend.recs_blend(ctx, similar, markov, popular, rules, _stocks(spark, "1234"))
    assert [r.ProductID for r in recs.orderBy("Rank").collect()] == ["1", "3", "2", "4"]


def test_stock_filter_and_cold_client_uses_any_country(spark):
    persona = spark.createDataFrame([("new", "No Transactions")], "ClientID string, Persona string")
    last = _ctx(spark).drop("Persona").limit(0)
    popular = spark.createDataFrame([("1", 1, "F"), ("2", 2, "F")], "ProductID string, Rank int, FamilyLevel2 string")
    stocks = spark.createDataFrame([("A", "1", 0), ("B", "2", 3)], "StoreCountry string, ProductID string, Quantity int")
    rules = spark.createDataFrame([], "antecedent string, consequent string, lift double")
    recs = recommend.recommendations(persona, last, popular, popular.limit(0), rules, stocks)
    assert [r.ProductID for r in recs.collect()] == ["2"]


def test_route_override_sends_persona_to_blend(spark):
    persona = spark.createDataFrame([("c1", "Loyal/Top (Mid Freq)")], "ClientID string, Persona string")
    last = _ctx(spark).drop("Persona")
    similar = spark.createDataFrame([("L", "2", 0.9, 1)], "ProductID string, SimilarProductID string, similarity double, Rank int")
    markov = spark.createDataFrame([], "Country string, State string, NextState string, prob double, Rank int")
    popular = spark.createDataFrame([("3", 1, "F3")], "ProductID string, Rank int, FamilyLevel2 string")
    rules = spark.createDataFrame([("L", "1", 2.0)], "antecedent string, consequent string, lift double")
    stocks = _stocks(spark, "123")
    plain = recommend.recommendations(persona, last, popular, popular.limit(0), rules, stocks)
    assert [r.ProductID for r in plain.orderBy("Rank").collect()] == ["1", "3"]          # loyal route
    over = recommend.recommendations(persona, last, popular, popular.limit(0), rules, stocks,
                                     route_overrides={"Loyal/Top (Mid Freq)": "blend"}, similar=similar, markov_top=markov)
    got = over.orderBy("Rank").collect()
    assert [r.ProductID for r in got] == ["2", "1", "3"] and {r.Route for r in got} == {"blend"}


def test_every_persona_and_route_end_to_end(spark, make_tx):
    """Six clients, one per persona rule, through counts, routing and lists."""
    from shopsignal.operators import customers
    segs = {"cold": "LOYAL", "vip": "TOP", "in_low": "INACTIVE_1Y", "in_mid": "INACTIVE_1Y", "loy_low": "LOYAL", "top_mid": "TOP", "other": "PROSPECT"}
    sales = {"vip": 16, "in_low": 2, "in_mid": 3, "loy_low": 1, "top_mid": 4, "other": 5}
    tx = make_tx([{"ClientID": c, "ProductID": "L", "BasketID": f"{c}{i}", "date": f"2024-01-{i + 1:02d} 00:00:00"} for c, n in sales.items() for i in range(n)])
    clients = spark.createDataFrame([(c, s, "C") for c, s in segs.items()], "ClientID string, ClientSegment string, ClientCountry string")
    personas = customers.personas(clients, tx)
    assert {r.ClientID: r.Persona for r in personas.collect()} == {
        "cold": "No Transactions", "vip": "Very Frequent (>15)", "in_low": "Inactive (Low Freq)", "in_mid": "Inactive (Mid Freq)",
        "loy_low": "Loyal/Top (Low Freq)", "top_mid": "Loyal/Top (Mid Freq)", "other": "Other (Active)"}
    last = customers.last_purchase(tx.selectExpr("*", "'FL' AS FamilyLevel2", "'C' AS ClientCountry"))
    popular = spark.createDataFrame([("1", 1, "F"), ("2", 2, "FL"), ("3", 3, "FL")], "ProductID string, Rank int, FamilyLevel2 string")
    rules = spark.createDataFrame([("L", "3", 2.0), ("L", "9", 3.0)], "antecedent string, consequent string, lift double")
    recs = recommend.recommendations(personas, last, popular, popular.limit(0), rules, _stocks(spark, "123"), top_n=2)
    got = {}
    for r in recs.orderBy("Rank").collect():
        got.setdefault((r.ClientID, r.Route), []).append(r.ProductID)
    assert got == {("cold", "static"): ["1", "2"], ("vip", "static"): ["1", "2"], ("in_low", "inactive"): ["2", "3"], ("in_mid", "inactive"): ["2", "3"],
                   ("loy_low", "loyal"): ["3", "1"], ("top_mid", "loyal"): ["3", "1"], ("other", "fallback"): ["1", "2"]}


def test_cold_client_sees_the_stock_of_its_own_country(spark):
    recs = spark.createDataFrame([("new", 1, "1")], "ClientID string, Rank int, ProductID string")
    products = spark.createDataFrame([("1", "c", "f1", "f2", "Men")], "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string, Universe string")
    clients = spark.createDataFrame([("new", "C")], "ClientID string, ClientCountry string")
    assert recommend.recs_enriched(recs, products, clients, _stocks(spark, "1")).first().Stock == 5


def test_blend_falls_back_to_the_global_matrix(spark):
    ctx = recommend.client_context(_ctx(spark).select("ClientID", "Persona"), _ctx(spark).drop("Persona"))
    similar = spark.createDataFrame([], "ProductID string, SimilarProductID string, similarity double, Rank int")
    markov = spark.createDataFrame([("X", "FL", "F9", 1.0, 1), ("Global", "FL", "F3", 1.0, 1)],
                                   "Country string, State string, NextState string, prob double, Rank int")
    popular = spark.createDataFrame([("9", 1, "F9"), ("3", 2, "F3")], "ProductID string, Rank int, FamilyLevel2 string")
    rules = spark.createDataFrame([], "antecedent string, consequent string, lift double")
    recs = recommend.recs_blend(ctx, similar, markov, popular, rules, _stocks(spark, "39"))
    # the prediction of the Global matrix comes first, then the pool
    assert [r.ProductID for r in recs.orderBy("Rank").collect()] == ["3", "9"]
