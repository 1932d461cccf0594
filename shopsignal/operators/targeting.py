"""Product → client targeting: catalog search, buyer sets, target scores, reverse rules,
stock availability."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.operators.numeric import top_k


def product_search(products_raw: DataFrame, q: str, fields=("FamilyLevel2", "Category", "FamilyLevel1")) -> DataFrame:
    """Case-insensitive *regex* containment on the given text fields (NULL never matches), or
    an exact ProductID when the query is numeric."""
    if q.strip().lstrip("-").isdigit():
        return products_raw.filter(F.col("ProductID") == F.lit(str(int(q))))
    pat = "(?i)" + q
    cond = F.lit(False)
    for f in fields:
        cond = cond | F.coalesce(F.col(f).rlike(pat), F.lit(False))
    return products_raw.filter(cond)


def buyers_by_family(master: DataFrame) -> DataFrame:
    """Reverse index as a relation: (Kind, Key, ClientID) for families and categories."""
    fam = master.filter(F.col("FamilyLevel2").isNotNull() & F.col("ClientID").isNotNull()).select(
        F.lit("FamilyLevel2").alias("Kind"), F.col("FamilyLevel2").alias("Key"), "ClientID")
    cat = master.filter(F.col("Category").isNotNull() & F.col("ClientID").isNotNull()).select(
        F.lit("Category").alias("Kind"), F.col("Category").alias("Key"), "ClientID")
    return fam.union(cat).distinct()


def search_targets_simple(matches: DataFrame, master: DataFrame, persona_df: DataFrame) -> DataFrame:
    """Past buyers of the matched product families, with persona and country."""
    fams = matches.select("FamilyLevel2").distinct()
    buyers = master.join(fams, "FamilyLevel2", "left_semi").select("ClientID").distinct()
    return persona_df.join(buyers, "ClientID", "left_semi").select("ClientID", "Persona", "ClientCountry")


def target_score():
    return (F.coalesce(F.col("RFM_Score"), F.lit(0)) * 2 + F.coalesce(F.col("TransactionCount"), F.lit(0))
            - F.coalesce(F.col("Recency"), F.lit(999)) / 100.0)


def _target_ids(matches: DataFrame, index: DataFrame) -> DataFrame:
    """Buyers of matched families ∪ matched categories."""
    keys = (matches.select(F.lit("FamilyLevel2").alias("Kind"), F.col("FamilyLevel2").alias("Key"))
            .union(matches.select(F.lit("Category"), F.col("Category"))).distinct())
    return index.join(keys, ["Kind", "Key"], "left_semi").select("ClientID").distinct()


def search_targets(matches: DataFrame, index: DataFrame, client_feats: DataFrame, country=None,
                   k: int = 50) -> DataFrame:
    """Buyers of matched families ∪ matched categories, optionally in one country, ranked
    by 2·RFM + transactions − recency/100; top ``k`` (the report). ``audience_size`` counts all."""
    t = client_feats.join(_target_ids(matches, index), "ClientID", "left_semi")
    if country is not None:                       # a value or a scalar-subquery column
        t = t.filter(F.col("ClientCountry") == (country if not isinstance(country, str) else F.lit(country)))
    t = t.withColumn("TargetScore", target_score())
    return top_k(t, [], [F.round("TargetScore", 6).desc(), F.col("ClientID")], k)


def audience_size(matches: DataFrame, index: DataFrame, client_feats: DataFrame) -> DataFrame:
    """One row: how many products match and how many clients bought from their families or categories."""
    t = client_feats.join(_target_ids(matches, index), "ClientID", "left_semi")
    return t.agg(F.countDistinct("ClientID").alias("Audience")).withColumn(
        "Matches", matches.select(F.count(F.lit(1))).scalar())


def search_target_personas(matches: DataFrame, index: DataFrame, client_feats: DataFrame) -> DataFrame:
    return (client_feats.join(_target_ids(matches, index), "ClientID", "left_semi").groupBy("Persona")
            .agg(F.count(F.lit(1)).alias("Clients")))


def sales_under_rules(rules: DataFrame, master: DataFrame) -> DataFrame:
    """(ProductID, ClientID) of the sales of products that a rule names."""
    named = rules.select(F.explode(F.array("antecedent", "consequent")).alias("ProductID")).distinct()
    return master.filter(F.col("ClientID").isNotNull()).select("ProductID", "ClientID").join(named, "ProductID", "left_semi")


def reverse_rule_targets(rules: DataFrame, master: DataFrame, persona_df: DataFrame) -> DataFrame:
    """For every rule consequent (target): buyers of its driver products (antecedents of
    rules into it) who never bought the target."""
    drivers = rules.select(F.col("consequent").alias("Target"), F.col("antecedent").alias("ProductID")).distinct()
    bought = sales_under_rules(rules, master).distinct()
    cand = drivers.join(bought, "ProductID").select("Target", "ClientID").distinct()
    owners = bought.select(F.col("ProductID").alias("Target"), "ClientID")
    t = cand.join(owners, ["Target", "ClientID"], "left_anti")
    return t.join(persona_df.select("ClientID", "Persona", "ClientCountry"), "ClientID", "left")


def stock_pivot(matches: DataFrame, stocks: DataFrame, products_raw: DataFrame) -> DataFrame:
    """Matched products × countries holding stock rows for them, summed, zero-filled
    (long form of the availability pivot; ``bi.pivot_wide`` gives a column per country)."""
    s = stocks.join(matches.select("ProductID"), "ProductID", "left_semi")
    sums = s.groupBy("ProductID", "StoreCountry").agg(F.sum("Quantity").cast("bigint").alias("Quantity"))
    countries = s.select("StoreCountry").distinct()
    prods = s.select("ProductID").distinct()
    # countries present are bounded (ISO list): explode the list instead of a join
    clist = countries.agg(F.sort_array(F.collect_list("StoreCountry"))).scalar()
    grid = prods.select("ProductID", F.explode(clist).alias("StoreCountry"))
    out = grid.join(sums, ["ProductID", "StoreCountry"], "left").withColumn("Quantity", F.coalesce("Quantity", F.lit(0)))
    return out.join(products_raw.select("ProductID", F.col("FamilyLevel2").alias("Product")), "ProductID", "left")
