"""NULL-key rules (no NULL-to-NULL matches, NULL groups ignored) and embedding invariants."""
import math

from pyspark.sql import functions as F

from shopsignal.operators import baskets, features, sequences
from shopsignal.plans.context import context

SF = "/root/testdata/sf0.001"


def test_null_product_key_never_matches(spark, make_tx):
    tx = make_tx([{"ProductID": None}, {"ProductID": "p1"}])
    products = spark.createDataFrame([(None, "X", "F1", "F2", "U"), ("p1", "C", "F1", "F2", "U")],
                                     "ProductID string, Category string, FamilyLevel1 string, FamilyLevel2 string, Universe string")
    clients = spark.createDataFrame([("c1", "LOYAL", "A", "M", 0, 0, 0)],
                                    "ClientID string, ClientSegment string, ClientCountry string, ClientGender string, "
                                    "HasEmail int, HasPhone int, HasContact int")
    stores = spark.createDataFrame([("s1", "A")], "StoreID string, StoreCountry string")
    m = {r.ProductID: r.Category for r in features.master_join(tx, products, clients, stores).collect()}
    assert m == {None: None, "p1": "C"}


def test_null_items_ignored_in_baskets(make_tx):
    rows = [{"BasketID": "b", "ProductID": p} for p in ["a", None, "b"]] + [{"BasketID": "c", "ProductID": p} for p in ["a", None]]
    rules = baskets.association_rules(make_tx(rows), "ProductID", min_count=1)
    assert {(r.antecedent, r.consequent) for r in rules.collect()} == {("a", "b"), ("b", "a")}


def test_prod2vec_vocabulary_and_vectors(spark):
    x = context(spark, SF)
    emb = x.embeddings
    vocab = {r.ProductID for r in emb.select("ProductID").collect()}
    counts = x.master.filter(F.col("ClientID").isNotNull()).groupBy("ProductID").count()
    expected = {r.ProductID for r in counts.filter("count >= 2").collect()}
    assert vocab == expected
    sample = emb.limit(20).collect()
    assert all(len(r.embedding) == 32 and all(math.isfinite(v) for v in r.embedding) for r in sample)
    lookup = sequences.embedding_lookup(x.products, emb)
    unknown = lookup.filter("known = 0").first()
    if unknown is not None:
        assert unknown.embedding == [0.0] * 32
