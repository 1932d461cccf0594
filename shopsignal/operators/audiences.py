"""Buyer sets as bitmaps over numbered clients: unions, differences and sizes without a row per buyer and target.

``targeting.reverse_rule_targets`` and ``search_targets`` list every (target, client). Where only sizes are asked, or
only some targets' lists, a bitmap index answers: clients are numbered without gaps, each key's buyers
are one bitmap per bucket of 32,768 clients (Spark's bitmap aggregates), sets are united by
``bitmap_or_agg``, and |A without B| is |A or B| - |B|, so no difference is ever built. A bucket none of whose clients
bought has no row. Bitmaps of few buyers are mostly zeros and shrink to a few bytes in parquet and shuffles.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.operators.numeric import materialize, ordered_scan

BUCKET_BITS = 32_768


def number_clients(ids: DataFrame) -> DataFrame:
    """(ClientID, Number) for the distinct ids, numbered from 1 in their order by the distributed scan. NULL is no client."""
    distinct = ids.select("ClientID").filter("ClientID is not null").distinct()
    return materialize(ordered_scan(distinct, [], ["ClientID"], prefix="n_").select("ClientID", F.col("n_rn").cast("long").alias("Number")), "client-numbers")


def buyer_bitmaps(bought: DataFrame, keys: Sequence[str], numbers: DataFrame) -> DataFrame:
    """(keys, Bucket, Bits): the buyers of each key as bitmaps. Clients without a number are left out, so are NULL keys."""
    pairs = materialize(bought.select(*keys, "ClientID").dropna().distinct(), "buyers").join(numbers, "ClientID")     # the sales' shuffles are gone before the join's
    n = F.col("Number")
    return pairs.groupBy(*keys, F.bitmap_bucket_number(n).alias("Bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("Bits"))


def united(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of all bitmaps with the same ``by`` and bucket."""
    return sets.groupBy(*by, "Bucket").agg(F.bitmap_or_agg("Bits").alias("Bits"))


def sizes(sets: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("Bits")).alias(name))


def members(sets: DataFrame, by: Sequence[str], numbers: DataFrame) -> DataFrame:
    """(by, ClientID): the clients of the given bitmaps; call it for the targets of one campaign."""
    @F.pandas_udf("array<int>")
    def places(bits: pd.Series) -> pd.Series:
        return bits.map(lambda b: np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")).astype(np.int32))

    number = (F.col("Bucket") - 1) * BUCKET_BITS + F.col("Place") + 1
    return sets.select(*by, "Bucket", F.explode(places("Bits")).alias("Place")).select(*by, number.alias("Number")).join(numbers, "Number").select(*by, "ClientID")


def rule_sets(rules: DataFrame, product_bits: DataFrame) -> DataFrame:
    """Per rule target and bucket: ``Bits`` of all buyers of its drivers or of itself, ``Own`` of its own buyers."""
    drivers = rules.select(F.col("consequent").alias("Target"), F.col("antecedent").alias("ProductID")).distinct()
    asked = drivers.withColumn("own", F.lit(False)).unionByName(drivers.select("Target", F.col("Target").alias("ProductID")).distinct().withColumn("own", F.lit(True)))
    return asked.join(product_bits, "ProductID").groupBy("Target", "Bucket").agg(
        F.bitmap_or_agg("Bits").alias("Bits"), F.bitmap_or_agg(F.when(F.col("own"), F.col("Bits"))).alias("Own"))


def rule_audiences(rules: DataFrame, product_bits: DataFrame) -> DataFrame:
    """(Target, Drivers, Owners, Audience) for every rule target: how many bought one of its drivers, but never itself."""
    drivers = rules.groupBy(F.col("consequent").alias("Target")).agg(F.countDistinct("antecedent").alias("Drivers"))
    s = rule_sets(rules, product_bits).groupBy("Target").agg(F.sum(F.bitmap_count("Bits")).alias("all"), F.sum(F.bitmap_count("Own")).alias("Owners"))
    return drivers.join(s, "Target", "left").select("Target", "Drivers", F.coalesce("Owners", F.lit(0)).alias("Owners"),
                                                    F.coalesce(F.col("all") - F.col("Owners"), F.lit(0)).alias("Audience"))


def rule_members(rules: DataFrame, product_bits: DataFrame, numbers: DataFrame) -> DataFrame:
    """(Target, ClientID) of the audiences of ``rules``: give the rules of the targets that a campaign needs."""
    s = rule_sets(rules, product_bits)
    everyone = members(s.select("Target", "Bucket", "Bits"), ["Target"], numbers)
    owners = members(s.select("Target", "Bucket", F.col("Own").alias("Bits")), ["Target"], numbers)
    return everyone.join(owners, ["Target", "ClientID"], "left_anti")


def search_audiences(hits: DataFrame, products: DataFrame, index_bits: DataFrame) -> DataFrame:
    """(term, Matches, Audience) for every term that finds a product: how many products it finds, and how many clients bought
    from their families or categories. ``hits`` (term, ProductID); ``index_bits`` by (Kind, Key).

    Terms that find the same families and categories have the same audience, so bitmaps are united for one term of each such
    set. Sets are compared by their size and two hashes of 64 bits, added up and combined bit by bit."""
    found = materialize(hits.select("term", "ProductID").distinct(), "term-hits")     # read twice
    matches = found.groupBy("term").agg(F.count(F.lit(1)).alias("Matches"))
    p = products.select("ProductID", F.explode(F.array(
        F.struct(F.lit("FamilyLevel2").alias("Kind"), F.col("FamilyLevel2").alias("Key")),
        F.struct(F.lit("Category").alias("Kind"), F.col("Category").alias("Key")))).alias("k")).select("ProductID", "k.*").dropna().distinct()
    keys = materialize(found.join(p.hint("merge"), "ProductID").select("term", "Kind", "Key").distinct(), "term-keys")
    same = ["_keys", "_sum", "_xor"]
    sets = keys.groupBy("term").agg(F.count(F.lit(1)).alias("_keys"), F.sum(F.xxhash64("Kind", "Key").cast("decimal(20,0)")).alias("_sum"),
                                    F.bit_xor(F.xxhash64(F.lit("second"), "Kind", "Key")).alias("_xor"))
    asked = sets.groupBy(*same).agg(F.min("term").alias("_asked"))
    of_asked = keys.join(asked.select(F.col("_asked").alias("term")), "term", "left_semi")
    united_sizes = sizes(united(of_asked.join(index_bits, ["Kind", "Key"]), ["term"]), ["term"], "Audience")
    audience = sets.join(asked.join(united_sizes.withColumnRenamed("term", "_asked"), "_asked"), same).select("term", "Audience")
    return matches.join(audience, "term", "left").select("term", "Matches", F.coalesce("Audience", F.lit(0)).alias("Audience"))
