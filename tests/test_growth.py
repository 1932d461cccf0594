"""What grows with the input: sizes the optimizer sees, exchanges of sales, rows compared as rows, pairs that are never shuffled."""
import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsignal.operators import audiences, baskets, bi, cleaning, customers, features, numeric, recommend, similarity, targeting, term_search
from shopsignal.plans.oracle import ORACLE_SQL
from shopsignal.sources import retail


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("part", [(i,) for i in range(200)] + [(None,), (7,)], "p_partkey long")
    put("nation", [(i, f"N{i}") for i in range(25)] + [(None, "X"), (3, None)], "n_nationkey long, n_name string")
    put("lineitem", [(o, p, 1, p, Decimal(2), Decimal(5)) for o in (1, 2, None) for p in (1, 1, 2)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity decimal(15,2), l_extendedprice decimal(15,2)")
    put("orders", [(1, 1, dt.datetime(2000, 1, 1)), (2, 2, dt.datetime(2000, 1, 2)), (None, 3, dt.datetime(2000, 1, 3))],
        "o_orderkey long, o_custkey long, o_orderdate timestamp")
    return str(tmp_path)


def test_the_optimizer_sees_the_size_of_the_stock_grid(spark, folder):
    stocks = retail.fixture_stocks(spark, folder)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(stocks) > 10 * size(spark.read.parquet(f"{folder}/part.parquet"))
    want = sum((p + n) % 4 != 0 for p in [*range(200), 7] for n in [*range(25), 3])
    assert stocks.count() == want and stocks.filter("StoreCountry is null").count() == sum((p + 3) % 4 != 0 for p in [*range(200), 7])


def test_clean_sales_are_not_dealt_out_again_after_their_join(spark, folder):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = cleaning.clean_transactions(retail.fixture_transactions(spark, folder))
        assert plan(clean).count("Exchange hashpartitioning") == 2
        assert sorted((r.BasketID, r.ProductID) for r in clean.collect()) == [("1", "1"), ("1", "2"), ("2", "1"), ("2", "2")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_last_and_first_sales_compare_the_rows_of_one_moment(spark, make_tx):
    rows = [{"ClientID": c, "ProductID": p, "date": d, "BasketID": b} for c, p, d, b in
            [("c1", "p1", "2024-01-01 00:00:00", "1"), ("c1", "p2", "2024-01-05 00:00:00", "1"), ("c1", "p3", "2024-01-05 00:00:00", "2"),
             ("c2", "p1", "2024-01-01 00:00:00", "0"), (None, "p9", "2024-01-09 00:00:00", "3")]]
    products = spark.createDataFrame([(f"p{i}", f"f{i}") for i in range(4)], "ProductID string, FamilyLevel2 string")
    m = make_tx(rows).join(products, "ProductID", "left").withColumn("ClientCountry", F.lit("FR"))
    last = customers.last_purchase(m)
    assert "LeftSemi" in plan(last)
    assert {r.ClientID: (r.LastProductID, r.LastFamilyLevel2) for r in last.collect()} == {"c1": ("p3", "f3"), "c2": ("p1", "f1")}
    first = bi.first_sales(m, "BasketID", "FamilyLevel2")
    assert "LeftSemi" in plan(first)
    assert {r.ProductID: r.BasketID for r in first.collect()} == {"p1": "0", "p2": "1", "p3": "2", "p9": "3"}
    # a sale without a date is before all others, and after none
    undated = m.withColumn("SaleTransactionDate", F.when(F.col("BasketID") != "1", F.col("SaleTransactionDate")))
    assert {r.ClientID: r.LastProductID for r in customers.last_purchase(undated).collect()} == {"c1": "p3", "c2": "p1"}
    assert {r.ProductID: r.BasketID for r in bi.first_sales(undated, "BasketID").collect()} == {"p1": "1", "p2": "1", "p3": "2", "p9": "3"}


def test_cross_sell_pairs_are_not_shuffled(spark):
    fam = spark.createDataFrame([("p1", "f"), ("p1", "f"), ("p2", "f"), ("p3", "g"), ("p4", None)], "ProductID string, FamilyLevel1 string")
    scores = spark.createDataFrame([(c, f, 1.0) for c in ("c1", "c2", "c3") for f in ("f", "g")], "ClientID string, FamilyLevel1 string, Score double")
    owners = spark.createDataFrame([("p1", "c1"), ("p3", "c2"), ("p9", "c3")], "ProductID string, ClientID string")
    got = customers._without_owners(fam, scores, owners)
    assert "LeftAnti" not in plan(got)
    want = fam.join(scores, "FamilyLevel1").join(owners, ["ProductID", "ClientID"], "left_anti")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count() == 9


def test_cross_sell_lists_are_whole():
    assert "Rank" not in ORACLE_SQL["propensity_cross_sell"]


def test_exploded_tables_are_not_broadcast(spark):
    products = spark.createDataFrame([("1", "A", "b", "red ring"), ("2", None, "b", "ring"), ("3", "C", "b", None)], "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string")
    terms = spark.createDataFrame([("ring",), (" 3 ",), ("zz",)], "term string")
    hits = term_search.search_terms(products, terms)
    assert sorted(map(tuple, hits.collect())) == [(" 3 ", "3"), ("ring", "1"), ("ring", "2")]
    index = spark.createDataFrame([("FamilyLevel2", "ring", "c1"), ("Category", "A", "c2"), ("Category", "C", "c1")], "Kind string, Key string, ClientID string")
    bits = audiences.buyer_bitmaps(index, ["Kind", "Key"], audiences.number_clients(index))
    found = audiences.search_audiences(hits.cache(), products, bits)
    assert sorted(map(tuple, found.collect())) == [(" 3 ", 1, 1), ("ring", 2, 2)]
    assert plan(term_search.search_terms(products, terms)).count("SortMergeJoin") >= 3


def test_sales_under_rules(spark):
    rules = spark.createDataFrame([("p1", "p2")], "antecedent string, consequent string")
    sales = spark.createDataFrame([("p1", "c1"), ("p2", "c2"), ("p3", "c1"), ("p1", None)], "ProductID string, ClientID string")
    assert sorted(map(tuple, targeting.sales_under_rules(rules, sales).collect())) == [("p1", "c1"), ("p2", "c2")]


def test_stock_by_product_is_not_exchanged_for_its_regions(spark, folder, monkeypatch):
    monkeypatch.setattr(retail, "GRID_PARTS", 10)
    stocks = retail.fixture_stocks(spark, folder)
    assert stocks.rdd.getNumPartitions() == 21               # 202 parts, 10 a task
    regions = recommend.available_products(stocks)
    assert plan(regions).count("Exchange hashpartitioning") == 1      # of the parts alone
    rows = {(r.StoreCountry, r.ProductID) for r in stocks.filter("Quantity > 0").collect()}
    want = rows | {(recommend.ANY_COUNTRY, p) for _, p in rows}
    got = [(r.Region, r.ProductID) for r in regions.collect()]
    assert len(got) == len(want) and set(got) == want


def test_only_the_asked_routes_are_made(spark):
    personas = spark.createDataFrame([("c1", "No Transactions"), ("c2", "Loyal (Low Freq)"), ("c3", "Inactive (Low Freq)")], "ClientID string, Persona string")
    last = spark.createDataFrame([("c2", "p1", "f1", "FR", dt.datetime(2024, 1, 1))], "ClientID string, LastProductID string, LastFamilyLevel2 string, LastClientCountry string, LastDate timestamp")
    popular = spark.createDataFrame([("p1", 1.0, "f1", 1), ("p2", 1.0, "f2", 2)], "ProductID string, FinalScore double, FamilyLevel2 string, Rank int")
    rules = spark.createDataFrame([("p1", "p3", 2.0)], "antecedent string, consequent string, lift double")
    stocks = spark.createDataFrame([("FR", "p1", 1), ("FR", "p2", 0), ("FR", "p3", 4), ("DE", "p2", 1)], "StoreCountry string, ProductID string, Quantity int")
    whole = recommend.recommendations(personas, last, popular, popular, rules, stocks)
    some = recommend.recommendations(personas, last, popular, popular, None, stocks, routes=["static", "fallback"])      # no rule is read
    rows = lambda df: sorted((r.ClientID, r.Route, r.Rank, r.ProductID) for r in df.collect())
    assert rows(some) == [r for r in rows(whole) if r[1] in ("static", "fallback")] and rows(some)
    assert ("c2", "loyal", 1, "p3") in rows(whole)


def test_sales_are_dealt_out_once_by_product_and_once_by_client(spark, make_tx):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tx = make_tx([{"ClientID": c, "ProductID": p, "amount": 10 * i + 1} for i, (c, p) in enumerate([("c1", "p1"), ("c1", "p2"), (None, "p1"), ("c2", None)])])
        products = spark.createDataFrame([("p1", "A"), ("p2", "B")], "ProductID string, Category string")
        m = tx.join(products.groupBy("ProductID").agg(F.min("Category").alias("Category")).withColumnRenamed("ProductID", "_key"),
                    features.spread_key("ProductID") == F.col("_key"), "left").drop("_key")
        rfm = spark.createDataFrame([("c1", 3)], "ClientID string, RFM_Score int")
        out = bi.final_features(m, rfm)
        # by product: the rows, and the sales whose categories are added up to the favourite
        assert plan(out).count("Exchange hashpartitioning(coalesce(ProductID") == 2
        assert plan(out).count("Exchange hashpartitioning(coalesce(ClientID") == 1
        got = sorted((r.ClientID or "", r.ProductID or "", r.RFM_Score, r.FavoriteCategory, r.IsFavoriteCategory, r.ProductTransactionCount) for r in out.collect())
        assert got == [("", "p1", None, None, 0, 2), ("c1", "p1", 3, "B", 0, 2), ("c1", "p2", 3, "B", 1, 1), ("c2", "", None, None, 0, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_large_dimension_is_not_sent_through_the_driver(spark, make_tx, monkeypatch, tmp_path):
    products = spark.createDataFrame([(f"p{i}", "A", "B", "C", "D") for i in range(3)], "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string, Universe string")
    products.write.parquet(f"{tmp_path}/products")
    products = spark.read.parquet(f"{tmp_path}/products")
    clients = spark.createDataFrame([], "ClientID string, ClientSegment string, ClientCountry string, ClientGender string, HasEmail int, HasPhone int, HasContact int")
    stores = spark.createDataFrame([], "StoreID string, StoreCountry string")
    sold = lambda p: features.master_join(make_tx([{"ProductID": "p1"}]), p, clients, stores).groupBy("Category").count()
    assert "SortMergeJoin" not in plan(sold(numeric.sized(products)))
    monkeypatch.setattr(numeric, "BROADCAST_ROWS", 2)
    assert "SortMergeJoin" in plan(sold(numeric.sized(products)))
    assert [tuple(r) for r in sold(numeric.sized(products)).collect()] == [("A", 1)]


def test_many_orders_are_not_sent_through_the_driver(spark, monkeypatch, tmp_path):
    from shopsignal.sources.retail import fixture_transactions
    spark.sql("SELECT id AS l_orderkey, id AS l_partkey, id AS l_suppkey, 1 AS l_linenumber, 2 AS l_quantity, 3.0 AS l_extendedprice FROM range(4)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, timestamp_ntz'1998-01-01 00:00:00' AS o_orderdate FROM range(3)").write.parquet(f"{tmp_path}/orders.parquet")
    few = fixture_transactions(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan(few)
    monkeypatch.setattr(numeric, "BROADCAST_ROWS", 2)
    many = fixture_transactions(spark, str(tmp_path))
    assert "SortMergeJoin" in plan(many) and "Broadcast" not in plan(many)
    assert sorted(r.BasketID for r in many.collect()) == sorted(r.BasketID for r in few.collect()) == ["0", "1", "2"]
    since = fixture_transactions(spark, str(tmp_path), since=dt.datetime(2021, 1, 1))
    assert "SortMergeJoin" in plan(since) and since.count() == 3


def test_vectors_are_projected_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    v, planes = rng.standard_normal((50, 8)), rng.standard_normal((8, 12))
    whole = similarity.bucket_keys(v, planes, 4, 3)
    held = []
    class Watched(np.ndarray):
        def __matmul__(self, other):
            held.append(len(self))
            return np.asarray(self) @ np.asarray(other)
    monkeypatch.setattr(similarity, "SCORE_BYTES", 16 * 12 * 7)
    assert (similarity.bucket_keys(v.view(Watched), planes, 4, 3) == whole).all() and max(held) == 7
    assert whole.max() < 8 and whole[0, 1] == sum((v[0] @ planes[:, 3 + b] >= 0) << b for b in range(3))


def test_pattern_growth_has_more_tasks_where_there_are_more_sales(spark, make_tx, monkeypatch):
    from pyspark.ml import fpm
    seen, real = [], fpm.FPGrowth.fit
    monkeypatch.setattr(fpm.FPGrowth, "fit", lambda self, sets: seen.append(self.getOrDefault("numPartitions")) or real(self, sets))
    monkeypatch.setattr(baskets, "TREE_ROWS", 2)
    tx = make_tx([{"BasketID": f"b{i // 3}", "ProductID": f"p{i % 4}"} for i in range(60)])
    got = baskets.rules_by_pattern_growth(tx, min_count=2)
    want = baskets.association_rules(tx, min_count=2)
    rows = lambda df: sorted((r.antecedent, r.consequent, r.pair_count) for r in df.collect())
    assert rows(got) == rows(want) and seen == [30]


def test_refreshed_sales_meet_their_stores_once(spark, monkeypatch):
    from shopsignal.plans import catalog, storage
    from shopsignal.plans.context import context
    seen, real = [], storage.refresh
    monkeypatch.setattr(catalog.storage, "refresh", lambda df, root: seen.append(df.inputFiles()) or real(df, root))
    catalog.q_country_refresh(context(spark, "/root/testdata/sf0.001"))
    assert len(seen) == 2 and all("sales-with-country" in f for files in seen for f in files)


def test_the_search_of_a_campaign_reads_products_without_a_category(spark, tmp_path):
    from shopsignal.plans import catalog
    from shopsignal.plans.context import Ctx
    put = lambda name, sql: spark.sql(sql).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    put("part", "SELECT id AS p_partkey, if(id < 2, 'red ring', 'cup') AS p_name, 'Brand#1' AS p_brand, 'TIN' AS p_type, cast(if(id = 1, 10, 3) AS int) AS p_size FROM range(3)")
    put("nation", "SELECT 0L AS n_nationkey, 'N0' AS n_name")
    put("supplier", "SELECT 0L AS s_suppkey, 0L AS s_nationkey")
    put("customer", "SELECT id AS c_custkey, 0L AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(2)")
    put("orders", "SELECT id AS o_orderkey, id AS o_custkey, timestamp'1998-01-01 00:00:00' AS o_orderdate FROM range(2)")
    put("lineitem", "SELECT id AS l_orderkey, id AS l_partkey, 0L AS l_suppkey, 1 AS l_linenumber, 2 AS l_quantity, 3.0 AS l_extendedprice FROM range(2)")
    got = catalog.q_cross_sell_search(Ctx(spark, str(tmp_path)))
    assert sorted((r.ProductID, r.ClientID) for r in got.collect()) == [("0", "1"), ("1", "0")]       # product 1 has no category
    assert "Category IS NOT NULL" not in ORACLE_SQL["propensity_cross_sell_search"].split("t JOIN products p")[0].rsplit("FROM", 2)[-1]


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_what_is_written_leaves_no_shuffle_files(spark):
    old = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = shuffle_files(spark)
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("v"))
    kept = numeric.materialize(df, "sums")
    scan = numeric.ordered_scan(df, [], ["k"], sum_col="v", prefix="s_")
    assert shuffle_files(spark) <= before
    assert kept.count() == 7 and scan.agg(F.max("s_cum")).first()[0] == sum(range(1000))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == old


def test_scans_write_what_is_kept(spark, make_tx):
    from shopsignal.operators import sequences
    from test_scale_forms import checkpointed
    tx = make_tx([{"ClientID": c, "ProductID": p, "date": f"2024-01-0{d} 00:00:00", "BasketID": b, "LineNo": 0} for c, p, d, b in
                  [("c1", "a", 1, "2"), ("c1", "b", 1, "1"), ("c1", "a", 3, "1"), ("c1", None, 4, "1"), ("c1", "b", 5, "1"), ("c2", "a", 1, "1")]])
    trans = sequences.markov_transitions(tx.withColumn("StoreCountry", F.lit("FR")), "ProductID")
    scans = checkpointed(trans)
    assert scans and all(s <= {"StoreCountry", "ClientID", "ProductID", "_scan_pid"} for s in scans)
    assert sorted((r.State, r.NextState, r.n) for r in trans.collect()) == [("b", "a", 1)]          # b and a of a day, by basket; a again; none; b
    seq = sequences.client_sequences(tx)
    assert all(s <= {"ClientID", "ProductID", "_scan_pid"} for s in checkpointed(seq))
    assert sorted((r.ClientID, r.Position, r.ProductID) for r in seq.collect()) == [("c1", 1, "b"), ("c1", 2, "a"), ("c1", 3, "a"), ("c1", 4, "b"), ("c2", 1, "a")]


def test_histories_are_scanned_part_by_part(spark, make_tx, monkeypatch):
    from shopsignal.operators import sequences
    tx = make_tx([{"ClientID": f"c{i % 9}", "ProductID": f"p{i * i % 7}", "date": f"2024-01-{i % 28 + 1:02d} 00:00:00", "BasketID": str(i)} for i in range(120)])
    tx = tx.withColumn("StoreCountry", F.when(F.col("ClientID") != "c8", F.concat(F.lit("N"), F.substring("BasketID", 1, 1))))
    seen, real = [], sequences.ordered_scan
    monkeypatch.setattr(sequences, "ordered_scan", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    for by in ("StoreCountry", None):
        found = []
        for most in (1_000_000, 30):
            monkeypatch.setattr(sequences, "PART_SALES", most)
            seen.clear()
            trans = sequences.markov_transitions(tx, "ProductID", by=by)
            found.append((trans.dtypes, sorted(trans.select("Country", "State", "NextState", "n", F.round("prob", 6)).collect())))
            rows = tx.filter(F.col(by).isNotNull()).count() if by else 120
            assert sum(seen) == rows and len(seen) == (1 if most > 30 else -(-rows // 30))
        assert found[0] == found[1] and found[0][1]


def test_prices_and_families_are_written_before_the_scores(spark, make_tx, monkeypatch):
    from shopsignal.operators import products
    tx = make_tx([{"ClientID": "c1", "ProductID": p, "date": f"2024-03-0{d} 00:00:00", "BasketID": str(d)} for p, d in (("p1", 1), ("p1", 2), ("p2", 3), (None, 4))])
    m = tx.withColumn("StoreCountry", F.lit("FR")).withColumn("FamilyLevel1", F.when(F.col("ProductID") == "p1", F.concat(F.lit("f"), "BasketID"))).withColumn("PricePerUnit", F.lit(4.0))
    seen, real = [], products.materialize
    monkeypatch.setattr(products, "materialize", lambda df, label: seen.append(label) or real(df, label))
    got = products.trending_scores(m, dt.datetime(2024, 3, 31), filtered=m).collect()
    assert seen == ["products-sold"]
    assert sorted((r.ProductID or "", r.FamilyLevel1, r.PricePerUnit) for r in got) == [("", "Unknown", 0.0), ("p1", "f2", 4.0), ("p2", "Unknown", 4.0)]


def test_bitmaps_are_united_once_for_terms_of_the_same_keys(spark, monkeypatch):
    products = spark.createDataFrame([(str(i), "A" if i % 2 else None, "b", f"f{i % 3}") for i in range(12)], "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string")
    hits = spark.createDataFrame([(str(i), str(i)) for i in range(12)] + [("all", str(i)) for i in range(12)] + [("gone", "99"), (None, "1")], "term string, ProductID string")
    index = spark.createDataFrame([("FamilyLevel2", f"f{i % 3}", f"c{i}") for i in range(9)] + [("Category", "A", "c20")], "Kind string, Key string, ClientID string")
    bits = audiences.buyer_bitmaps(index, ["Kind", "Key"], audiences.number_clients(index))
    seen, real = [], audiences.united
    monkeypatch.setattr(audiences, "united", lambda sets, by: seen.append({r.term for r in sets.select("term").collect()}) or real(sets, by))
    got = {r.term: (r.Matches, r.Audience) for r in audiences.search_audiences(hits, products, bits).collect()}
    want = {str(i): (1, 4 if i % 2 else 3) for i in range(12)} | {"all": (12, 10), "gone": (1, 0)}
    assert {t: v for t, v in got.items() if t is not None} == want
    assert len(seen[0]) == 7                   # three families with and without the category, and all of them


def test_the_first_row_of_each_product_is_the_first_sale(spark, make_tx):
    rows = [{"ClientID": c, "ProductID": p, "date": d, "BasketID": b, "amount": a} for c, p, d, b, a in
            [("c1", "p1", "2024-01-02 00:00:00", "1", 7), ("c2", "p1", "2024-01-02 00:00:00", "0", 8), (None, "p2", "2024-01-05 00:00:00", "1", 2), ("c1", None, "2024-01-01 00:00:00", "1", 1)]]
    tx = make_tx(rows)
    for m in (tx, tx.withColumn(cleaning.DATE, F.when(F.col("BasketID") == "1", F.col(cleaning.DATE)))):
        some = bi.first_rows(m)
        assert sorted(some.columns) == sorted(m.columns) and some.count() == 2
        cols = ["BasketID", "ClientID", cleaning.AMOUNT]
        assert sorted(bi.first_sales(some, *cols).collect(), key=str) == sorted(bi.first_sales(m, *cols).collect(), key=str)


def test_affinity_reads_sales_once(spark, make_tx):
    tx = make_tx([{"ClientID": c, "ProductID": p, "amount": a, "date": f"2024-01-0{a} 00:00:00"} for c, p, a in [("c1", "f", 1), ("c1", "f", 2), ("c1", "g", 3), ("c1", None, 4), (None, "f", 9)]])
    m = tx.withColumn("FamilyLevel1", F.col("ProductID")).withColumn("StoreCountry", F.lit("FR"))
    for aff in (customers.affinity_matrix(m), customers.affinity_matrix(m, by_country=True)):
        p = aff._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in p.replace("Join Inner, (StoreCountry", "") and "families" in "".join(aff.inputFiles()) and "client-sales" not in "".join(aff.inputFiles())
        got = sorted((r.FamilyLevel1, r.CategorySpend, r.PurchaseCount, r.TotalSpend, str(r.LastPurchaseDate)) for r in aff.collect())
        assert got == [("f", 3.0, 2, 10.0, "2024-01-04 00:00:00"), ("g", 3.0, 1, 10.0, "2024-01-04 00:00:00")]
