"""Bitmap audiences against explicit sets, over several buckets of clients."""
from pyspark.sql import functions as F

from shopsignal.operators import audiences, targeting


def test_sets_over_several_buckets(spark):
    clients = spark.range(100_000).select(F.format_string("c%06d", "id").alias("ClientID"))
    numbers = audiences.number_clients(clients.unionByName(clients.limit(50)))
    assert numbers.agg(F.min("Number"), F.max("Number"), F.countDistinct("Number")).first()[:] == (1, 100_000, 100_000)
    bought = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("Key"), F.format_string("c%06d", "id").alias("ClientID"))
    bought = bought.unionByName(spark.range(0, 100_000, 3).select(F.lit("three").alias("Key"), F.format_string("c%06d", "id").alias("ClientID")))
    bought = bought.unionByName(bought.limit(1_000)).unionByName(spark.createDataFrame([(None, "c000001"), ("odd", None), ("odd", "stranger")], "Key string, ClientID string"))
    bits = audiences.buyer_bitmaps(bought, ["Key"], numbers)
    assert {r.Key: r.n for r in audiences.sizes(bits, ["Key"], "n").collect()} == {"even": 50_000, "odd": 50_000, "three": 33_334}
    both = audiences.united(bits.filter("Key <> 'odd'").withColumn("g", F.lit(1)), ["g"])
    assert audiences.sizes(both, ["g"], "n").first().n == 66_667
    listed = {r.ClientID for r in audiences.members(both, ["g"], numbers).collect()}
    assert listed == {f"c{i:06d}" for i in range(100_000) if i % 2 == 0 or i % 3 == 0}


def rules_and_sales(spark):
    rules = spark.createDataFrame([("a", "t"), ("b", "t"), ("t", "a"), ("a", "b"), ("x", "nobody"), ("unsold", "b")], "antecedent string, consequent string")
    sold = [("a", f"c{i}") for i in range(40)] + [("b", f"c{i}") for i in range(30, 60)] + [("t", f"c{i}") for i in range(35, 45)] * 2 + [("a", None), ("x", "c99")]
    return rules, spark.createDataFrame(sold, "ProductID string, ClientID string")


def test_rule_audiences_count_and_list_the_same_clients(spark):
    rules, sales = rules_and_sales(spark)
    numbers = audiences.number_clients(sales)
    bits = audiences.buyer_bitmaps(sales, ["ProductID"], numbers)
    none = spark.createDataFrame([], "ClientID string, Persona string, ClientCountry string")
    want = {(r.Target, r.ClientID) for r in targeting.reverse_rule_targets(rules, sales, none).collect()}
    assert {(r.Target, r.ClientID) for r in audiences.rule_members(rules, bits, numbers).collect()} == want
    got = {r.Target: (r.Drivers, r.Owners, r.Audience) for r in audiences.rule_audiences(rules, bits).collect()}
    assert got["t"] == (2, 10, 50) and got["nobody"] == (1, 0, 1)
    assert {t: n for t, (_, _, n) in got.items()} == {t: sum(1 for x, _ in want if x == t) for t in got}


def test_sizes_need_no_row_per_target_and_buyer(spark):
    """Above the index no operator carries client ids."""
    rules, sales = rules_and_sales(spark)
    numbers = audiences.number_clients(sales)
    bits = audiences.buyer_bitmaps(sales, ["ProductID"], numbers)
    assert "ClientID" not in bits.columns
    plan = audiences.rule_audiences(rules, bits)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("bitmap_construct_agg")[0]
    assert "ClientID" not in top.split("\n")[0] and "bitmap_or_agg" in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    rules, sales = rules_and_sales(spark)
    numbers = audiences.number_clients(sales.limit(0))
    bits = audiences.buyer_bitmaps(sales.limit(0), ["ProductID"], numbers)
    assert numbers.count() == bits.count() == 0
    assert {r.Audience for r in audiences.rule_audiences(rules, bits).collect()} == {0}
    assert audiences.rule_audiences(rules.limit(0), bits).count() == 0
