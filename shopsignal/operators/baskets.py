"""Market-basket mining (pair rules) and the bundle / cross-sell views built on rules."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import ts_text
from shopsignal.operators.features import DATE
from shopsignal.operators.numeric import materialize, top_k
from shopsignal.session import default_partitions

TREE_ROWS = 100_000  # paths in a task's tree of pattern growth
PAIR_BLOCK = 1000   # items per block when a basket is split for pair generation (both sides)


def basket_ids(df: DataFrame) -> DataFrame:
    """BasketID when present, else Client_Date_Store."""
    if "BasketID" in df.columns:
        return df
    bid = F.concat_ws("_", F.col("ClientID").cast("string"), ts_text(DATE), F.col("StoreID").cast("string"))
    return df.withColumn("BasketID", bid)


def basket_items(df: DataFrame, item_col: str) -> DataFrame:
    """Distinct (basket, item) of multi-item baskets, with basket size. NULL items ignored."""
    bi = (basket_ids(df).filter(F.col(item_col).isNotNull())
          .select("BasketID", F.col(item_col).cast("string").alias("item")).distinct())
    sizes = bi.groupBy("BasketID").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > 1)
    return bi.join(sizes, "BasketID")


def association_rules(df: DataFrame, item_col: str = "ProductID", min_support: float = K.RULE_MIN_SUPPORT,
                      min_count: int | None = None) -> DataFrame:
    """Single-item rules a → b over multi-item baskets: support = n/N, confidence =
    support/sup(a), lift = confidence/sup(b); keep n ≥ N·min_support (or ``min_count``).

    Items that miss the threshold alone cannot be in a frequent pair, so they are pruned
    before pairing (N and item supports are taken before pruning). Pairs are generated
    by a self-join on basket; a big basket's items are dealt to blocks, and each pair of blocks
    meets on its own, so no join key has more than PAIR_BLOCK × PAIR_BLOCK pairs.
    """
    # (basket, item) feeds the basket count, the item counts and the pair join: written once
    items = materialize(basket_items(df, item_col), "baskets")
    n_baskets = F.lit(items.select(F.countDistinct("BasketID")).first()[0])
    item_n = items.groupBy("item").agg(F.count(F.lit(1)).alias("_n"))
    threshold = F.lit(min_count).cast("double") if min_count is not None else n_baskets.cast("double") * F.lit(min_support)
    keep = item_n.filter(F.col("_n").cast("double") >= threshold).select("item")
    pruned = items.join(keep, "item", "left_semi")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_size") / F.lit(PAIR_BLOCK))).cast("int")
    own = pruned.withColumn("_own", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    both = own.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = both.select("BasketID", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col("item").alias("a"))
    right = both.select("BasketID", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col("item").alias("b"))
    pairs = (left.join(right, ["BasketID", "_i", "_j"]).filter(F.col("a") < F.col("b"))
                 .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    both = (pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n")
                 .unionByName(pairs.select(F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "n")))
    both = both.filter(F.col("n").cast("double") >= threshold)
    nb = n_baskets.cast("double")
    ant = item_n.select(F.col("item").alias("antecedent"), F.col("_n").alias("ant_n"))
    con = item_n.select(F.col("item").alias("consequent"), F.col("_n").alias("con_n"))
    r = both.join(ant, "antecedent").join(con, "consequent")
    support = F.col("n") / nb
    return (r.withColumn("support", support)
             .withColumn("confidence", F.col("support") / (F.col("ant_n") / nb))
             .withColumn("lift", F.col("confidence") / (F.col("con_n") / nb))
             .select("antecedent", "consequent", F.col("n").cast("bigint").alias("pair_count"),
                     "support", "confidence", "lift"))


def rules_by_pattern_growth(df: DataFrame, item_col: str = "ProductID", min_support: float = K.RULE_MIN_SUPPORT,
                            min_count: int | None = None) -> DataFrame:
    """The rules of ``association_rules`` from Spark ML's FP-growth: another method for the same pairs.

    Pattern growth also finds every longer frequent set on its way, so it suits baskets of some dozen
    items or high thresholds; the pair join is the default. A task grows the sets of its own items from a tree of
    about TREE_ROWS paths, so there are more tasks where there are more sales.
    """
    from pyspark.ml.fpm import FPGrowth
    items = materialize(basket_items(df, item_col), "baskets")
    sets = items.groupBy("BasketID").agg(F.collect_list("item").alias("items"))
    n = items.select(F.countDistinct("BasketID")).first()[0]
    least = float(min_count) if min_count is not None else n * min_support
    # the trainer keeps sets of at least ceil(n * support) baskets; half a basket less guards against rounding
    support = max(0.0, (math.ceil(least) - 0.5) / n) if n else 1.0
    schema = "antecedent string, consequent string, pair_count long, support double, confidence double, lift double"
    if not n or support > 1:
        return df.sparkSession.createDataFrame([], schema)
    parts = max(default_partitions(df.sparkSession), -(-items.count() // TREE_ROWS))
    found = materialize(FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0, numPartitions=parts).fit(sets).freqItemsets.filter(F.size("items") <= 2), "frequent-sets")
    single = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    pairs = found.filter(F.size("items") == 2).select(F.explode(F.array(
        F.struct(F.col("items")[0].alias("antecedent"), F.col("items")[1].alias("consequent")),
        F.struct(F.col("items")[1].alias("antecedent"), F.col("items")[0].alias("consequent")))).alias("p"), F.col("freq").alias("pair_count")).select("p.*", "pair_count")
    r = pairs.join(single.select(F.col("item").alias("antecedent"), F.col("c").alias("a")), "antecedent") \
             .join(single.select(F.col("item").alias("consequent"), F.col("c").alias("b")), "consequent")
    total = F.lit(float(n))
    return (r.withColumn("support", F.col("pair_count") / total).withColumn("confidence", F.col("support") / (F.col("a") / total))
             .withColumn("lift", F.col("confidence") / (F.col("b") / total)).select("antecedent", "consequent", "pair_count", "support", "confidence", "lift"))


def rule_order():
    return [F.round("lift", 6).desc(), F.col("consequent")]


def rule_targets(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("consequent").alias("ProductID")).distinct()


def bundles_wide(fam_rules: DataFrame, k: int = 3) -> DataFrame:
    """Per family: its top 3 consequents by lift as Reco1..Reco3."""
    top = top_k(fam_rules, ["antecedent"], rule_order(), k)
    return top.groupBy(F.col("antecedent").alias("FamilyLevel2")).agg(
        *[F.max(F.when(F.col("Rank") == i, F.col("consequent"))).alias(f"Reco{i}") for i in range(1, k + 1)])


def bundle_products(fam_rules: DataFrame, products: DataFrame, stocks: DataFrame,
                    k_reco: int = 3, k_products: int = 3) -> DataFrame:
    """Per country and family: for each of its top reco families, up to 3 in-stock products
    (lowest ProductID first) with their stock."""
    recos = top_k(fam_rules, ["antecedent"], rule_order(), k_reco, rank_col="RecoRank")
    instock = (stocks.filter(F.col("Quantity") > 0)
               .join(products.select("ProductID", "FamilyLevel2", "Category", "Universe"), "ProductID"))
    first3 = top_k(instock, ["StoreCountry", "FamilyLevel2"], [F.col("ProductID")], k_products,
                   rank_col="ProductRank")
    out = recos.join(first3, recos.consequent == first3.FamilyLevel2)
    return out.select("StoreCountry", F.col("antecedent").alias("Family"), "RecoRank",
                      F.col("consequent").alias("Reco"), "ProductRank", "ProductID", "Category", "Universe",
                      F.col("Quantity").alias("Stock"))


def store_top_products(master: DataFrame, k: int = 10) -> DataFrame:
    """Per store: top products by units sold (tie → ProductID, family)."""
    units = (master.filter(F.col("StoreID").isNotNull()).groupBy("StoreID", "ProductID", "FamilyLevel2")
             .agg(F.sum("Quantity").cast("bigint").alias("Units")))
    return top_k(units, ["StoreID"], [F.col("Units").desc(), F.col("ProductID"), F.col("FamilyLevel2")], k)


def store_bundles(master: DataFrame, fam_rules: DataFrame, k: int = 10) -> DataFrame:
    """Per store: family rules whose antecedent is a family of its top-10 products, by lift.
    A store shows k rules, so k rules of each antecedent are enough to join."""
    fams = store_top_products(master).select("StoreID", F.col("FamilyLevel2").alias("antecedent")).distinct()
    cand = fams.join(top_k(fam_rules, ["antecedent"], rule_order(), k, rank_col="_of").drop("_of"), "antecedent")
    return top_k(cand, ["StoreID"], [F.round("lift", 6).desc(), F.col("antecedent"), F.col("consequent")], k)


def client_cross_sell(last: DataFrame, fam_rules: DataFrame, master: DataFrame, stocks: DataFrame,
                      clients: DataFrame, k: int = 3) -> DataFrame:
    """Per client: top-3 family rules from the family of the last purchase; an example product
    of each recommended family (lowest sold ProductID), its stock units in the client's country."""
    top = top_k(fam_rules, ["antecedent"], rule_order(), k)
    example = (master.filter(F.col("FamilyLevel2").isNotNull()).groupBy("FamilyLevel2")
               .agg(F.min_by(F.struct("ProductID", "Category", "Universe"), F.col("ProductID")).alias("_e"))
               .select(F.col("FamilyLevel2").alias("consequent"), "_e.*"))
    recs = (last.select("ClientID", F.col("LastFamilyLevel2").alias("antecedent"))
                .join(top, "antecedent").join(example, "consequent", "left")
                .join(clients.select("ClientID", "ClientCountry"), "ClientID", "left"))
    stock = stocks.groupBy("StoreCountry", "ProductID").agg(F.sum("Quantity").alias("_q"))
    out = recs.join(stock, (recs.ClientCountry == stock.StoreCountry) & (recs.ProductID == stock.ProductID), "left") \
              .drop(stock.ProductID).drop("StoreCountry")
    q = F.coalesce(F.col("_q"), F.lit(0)).cast("bigint")
    status = F.when(q > 0, F.concat(F.format_number(q, 0), F.lit(" units"))).otherwise("Out of Stock")
    return out.select("ClientID", F.col("antecedent").alias("LastFamily"), "Rank",
                      F.col("consequent").alias("Product"), "Category", "Universe",
                      q.alias("StockUnits"), status.alias("StockStatus"), "lift")
