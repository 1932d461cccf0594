"""Customer scoring: RFM, favourite category, personas, enrichment, affinity, propensity."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import day_delta, flag, safe_div
from shopsignal.operators.features import AMOUNT, DATE, QTY, at_moment, row_tiebreak
from shopsignal.operators.numeric import materialize, ordered_scan, quintile_scores, top_k
from shopsignal.session import default_partitions


def _with_client(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ClientID").isNotNull())


def rfm_base(master: DataFrame) -> DataFrame:
    """Per client: Recency (days to max date + 1 day), first/last, spend, mean, sample std,
    units, frequency, weekend ratio. ``master`` needs IsWeekend."""
    ref_date = master.select(F.max(DATE)).scalar() + F.expr("INTERVAL 1 DAY")
    amt = F.col(AMOUNT)
    agg = _with_client(master).groupBy("ClientID").agg(
        F.max(DATE).alias("LastPurchase"), F.min(DATE).alias("FirstPurchase"),
        F.sum(amt).alias("_spent"), F.stddev_samp(amt.cast("double")).alias("StdOrderValue"),
        F.sum(QTY).cast("bigint").alias("TotalQuantity"), F.count(F.lit(1)).alias("Frequency"),
        F.avg("IsWeekend").alias("WeekendShopperRatio"))
    return (agg.withColumn("Recency", day_delta(F.col("LastPurchase"), ref_date))
               .withColumn("TotalSpent", F.col("_spent").cast("double"))
               .withColumn("AvgOrderValue", F.col("TotalSpent") / F.col("Frequency"))
               .drop("_spent"))


def rfm_scores(rfm: DataFrame) -> DataFrame:
    s = quintile_scores(rfm, {"Recency": ("RecencyScore", False), "Frequency": ("FrequencyScore", True),
                              "TotalSpent": ("MonetaryScore", True)})
    return s.withColumn("RFM_Score", F.col("RecencyScore") + F.col("FrequencyScore") + F.col("MonetaryScore"))


def rfm_segments(scored: DataFrame) -> DataFrame:
    vol = F.coalesce(F.col("StdOrderValue") / F.greatest(F.col("AvgOrderValue"), F.lit(1.0)), F.lit(0.0))
    return (scored.withColumn("CustomerLifetimeDays", day_delta("FirstPurchase", "LastPurchase"))
                  .withColumn("PriceVolatility", vol)
                  .withColumn("IsHighValue", flag(F.col("MonetaryScore") >= 4))
                  .withColumn("IsFrequentBuyer", flag(F.col("FrequencyScore") >= 4))
                  .withColumn("IsRecentBuyer", flag(F.col("RecencyScore") >= 4))
                  .withColumn("IsAtRisk", flag((F.col("RecencyScore") <= 2) & (F.col("FrequencyScore") >= 3))))


def customer_rfm(master: DataFrame) -> DataFrame:
    return rfm_segments(rfm_scores(materialize(rfm_base(master), "rfm")))   # one row per client, read twice


def favorite_category(master: DataFrame) -> DataFrame:
    """Category with the highest spend per client; ties → alphabetically first; NULL
    categories are ignored."""
    spend = (_with_client(master).filter(F.col("Category").isNotNull())
             .groupBy("ClientID", "Category").agg(F.sum(AMOUNT).alias("_spend")))
    return spend.groupBy("ClientID").agg(
        F.min_by("Category", F.struct(-F.col("_spend"), F.col("Category"))).alias("FavoriteCategory"))


def add_favorite_flags(df: DataFrame, fav: DataFrame) -> DataFrame:
    return favorite_flags(df.join(fav, "ClientID", "left"))


def favorite_flags(out: DataFrame) -> DataFrame:
    same = flag(F.col("Category") == F.col("FavoriteCategory"))
    return out.withColumn("IsFavoriteCategory", same).withColumn("IsCrossSellOpportunity", 1 - same)


def personas(clients: DataFrame, raw_tx: DataFrame) -> DataFrame:
    """Clients ⟕ raw (uncleaned) sale counts, classified into the persona rules."""
    counts = _with_client(raw_tx).groupBy("ClientID").agg(F.count(F.lit(1)).alias("_n"))
    df = clients.join(counts, "ClientID", "left").withColumn("TransactionCount", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n")
    seg = F.upper(F.coalesce(F.col("ClientSegment"), F.lit("NAN")))
    n = F.col("TransactionCount")
    persona = (F.when(n == 0, K.NO_TRANSACTIONS)
                .when(n > 15, K.VERY_FREQUENT)
                .when(seg == "INACTIVE_1Y", F.when(n > 2, K.INACTIVE_MID).otherwise(K.INACTIVE_LOW))
                .when(seg.isin("LOYAL", "TOP"), F.when(n > 2, K.LOYAL_MID).otherwise(K.LOYAL_LOW))
                .otherwise(K.OTHER_ACTIVE))
    return df.withColumn("Persona", persona)


def persona_enriched(persona_df: DataFrame, master: DataFrame) -> DataFrame:
    """Persona table + spend, last date, units, recency (to max date), modal category,
    AvgOrderValue = clean spend / raw count; prospects get 0 / 999 / 'None', buyers without
    any category 'N/A'."""
    max_date = master.select(F.max(DATE)).scalar()
    stats = _with_client(master).groupBy("ClientID").agg(
        F.sum(AMOUNT).cast("double").alias("_spent"), F.max(DATE).alias("LastDate"),
        F.sum(QTY).cast("bigint").alias("TotalUnits"), F.coalesce(F.mode("Category", True), F.lit("N/A")).alias("_fav"))
    stats = stats.withColumn("_rec", day_delta(F.col("LastDate"), max_date))
    out = persona_df.join(stats, "ClientID", "left")
    return (out.withColumn("AvgOrderValue", safe_div(F.col("_spent"), F.col("TransactionCount").cast("double")))
               .withColumn("TotalSpent", F.coalesce("_spent", F.lit(0.0)))
               .withColumn("Recency", F.coalesce("_rec", F.lit(K.NEW_CLIENT_RECENCY)).cast("bigint"))
               .withColumn("FavoriteCategory", F.coalesce("_fav", F.lit("None")))
               .drop("_spent", "_rec", "_fav"))


def persona_distribution(persona_df: DataFrame) -> DataFrame:
    return persona_df.groupBy("Persona").agg(F.count(F.lit(1)).alias("Clients"))


def client_features(persona_enr: DataFrame, rfm: DataFrame) -> DataFrame:
    """The client card table: persona stats + RFM score (NULL for clients without clean sales)."""
    return persona_enr.join(rfm.select("ClientID", "RFM_Score"), "ClientID", "left")


def affinity_matrix(master: DataFrame, current_date=None, by_country: bool = False) -> DataFrame:
    """Per (client, FamilyLevel1): spend, count, share of wallet, affinity score
    (.7 share + .3 count / max count), days since the client's last purchase.

    ``by_country`` computes the same independently inside every StoreCountry.

    Sales are added up once, to a row per client and family that is written: clients' totals are taken over their families' rows.
    """
    keys = ["StoreCountry", "ClientID"] if by_country else ["ClientID"]
    src = _with_client(master)
    if by_country:
        src = src.filter(F.col("StoreCountry").isNotNull())
    if current_date is None:
        current_date = master.select(F.max(DATE)).scalar()
    src = materialize(src.select(*keys, "FamilyLevel1", AMOUNT, DATE), "client-sales")      # the joins' shuffles are gone before the sums'
    fam = materialize(src.groupBy(*keys, "FamilyLevel1").agg(
        F.sum(AMOUNT).alias("CategorySpend"), F.count(F.lit(1)).alias("PurchaseCount"),
        F.max(DATE).alias("_last")), "families")
    client = Window.partitionBy(*keys)          # a client's families, not its sales
    out = (fam.withColumn("TotalSpend", F.sum("CategorySpend").over(client))
              .withColumn("LastPurchaseDate", F.max("_last").over(client))
              .filter(F.col("FamilyLevel1").isNotNull()).drop("_last"))
    fam = fam.filter(F.col("FamilyLevel1").isNotNull())
    if by_country:
        # one row per country: a bounded side (ISO country list) for the broadcast
        cmax = fam.groupBy("StoreCountry").agg(F.max("PurchaseCount").alias("_maxc"))
        out = out.join(F.broadcast(cmax), "StoreCountry")
        max_count = F.col("_maxc")
    else:
        max_count = fam.select(F.max("PurchaseCount")).scalar()
    share = safe_div(F.col("CategorySpend").cast("double"), F.col("TotalSpend").cast("double"))
    return (out.withColumn("DaysSinceLastPurchase", day_delta(F.col("LastPurchaseDate"), current_date))
               .withColumn("ShareOfWallet", share)
               .withColumn("AffinityScore", F.col("ShareOfWallet") * K.AFFINITY_SPEND_W
                           + F.col("PurchaseCount") / max_count.cast("double") * K.AFFINITY_COUNT_W)
               .withColumn("CategorySpend", F.col("CategorySpend").cast("double"))
               .withColumn("TotalSpend", F.col("TotalSpend").cast("double"))
               .drop("_maxc"))


def propensity(aff: DataFrame, recency_weight: float = K.PROPENSITY_RECENCY_W) -> DataFrame:
    """RecencyFactor = 1/ln(days+2); score = aff·(1−w) + rec·w (all families at once)."""
    rec = safe_div(F.lit(1.0), F.log1p(F.col("DaysSinceLastPurchase") + 1))
    return (aff.withColumn("RecencyFactor", rec)
               .withColumn("PropensityScore", F.col("AffinityScore") * (1 - recency_weight)
                           + F.col("RecencyFactor") * recency_weight))


def propensity_cross_sell(master: DataFrame, products: DataFrame, targets: DataFrame,
                          country_master: DataFrame | None = None) -> DataFrame:
    """For each product of ``targets`` (a table with ProductID): clients scored on its
    FamilyLevel1, minus everyone who ever bought the product. Scores come from ``country_master``
    when given (one country's sales); the owners are always those of ``master``."""
    scores = propensity(affinity_matrix(country_master if country_master is not None else master))
    fam = targets.select("ProductID").distinct().join(products.select("ProductID", "FamilyLevel1"), "ProductID")
    return _without_owners(fam, scores, _with_client(master).select("ProductID", "ClientID").distinct())


def _without_owners(fam: DataFrame, scores: DataFrame, owners: DataFrame) -> DataFrame:
    """Every product of ``fam`` with every score of its family, less the pairs of ``owners``.

    The pairs are as many as products times clients: they are only ever streamed. Each score carries what its client owns of
    its family, scores are dealt to blocks by client, and the products of a family meet one block at a time, so what is
    shuffled and held grows with targets and sales. (Merge join: the repeated products are more than the optimizer sees.)"""
    owned = owners.join(fam.distinct(), "ProductID").groupBy("ClientID", "FamilyLevel1").agg(F.collect_set("ProductID").alias("_owned"))
    blocks = default_partitions(scores.sparkSession)
    dealt = scores.join(owned, ["ClientID", "FamilyLevel1"], "left").withColumn("_block", F.pmod(F.xxhash64("ClientID"), F.lit(blocks)).cast("int"))
    asked = fam.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = dealt.join(asked.hint("merge"), ["FamilyLevel1", "_block"]).filter(~F.coalesce(F.array_contains("_owned", F.col("ProductID")), F.lit(False)))
    first = ["ProductID", "ClientID", "FamilyLevel1"]
    return pairs.select(*first, *[c for c in scores.columns if c not in first])


CAMPAIGN_BLOCK = 1_000     # ranks per join key of a campaign


def cross_sell_campaign(master: DataFrame, products: DataFrame, targets: DataFrame, per_target: int = 50) -> DataFrame:
    """The ``per_target`` best clients of each product of ``targets`` (a table with ProductID) among those that
    ``propensity_cross_sell`` lists, without making that list: (ProductID, Rank, ClientID, PropensityScore, DaysSinceLastPurchase).

    Each family's clients are ranked once (ordered scan). A product with o owners finds its clients among the first
    ``per_target`` + o of its family, so products meet only that many ranks, in blocks: the work grows with targets and
    sales, not with products times clients.
    """
    scores = propensity(affinity_matrix(master)).select("FamilyLevel1", "ClientID", "PropensityScore", "DaysSinceLastPurchase")
    ranked = ordered_scan(scores.withColumn("_s", -F.round("PropensityScore", 6)), ["FamilyLevel1"], ["_s", "ClientID"], prefix="_f").drop("_s")
    ranked = ranked.withColumn("_block", F.floor((F.col("_frn") - 1) / CAMPAIGN_BLOCK))
    owners = _with_client(master).select("ProductID", "ClientID").distinct()
    own = owners.groupBy("ProductID").agg(F.count(F.lit(1)).alias("_owners"))
    asked = (targets.select("ProductID").distinct().join(products.select("ProductID", "FamilyLevel1"), "ProductID").join(own, "ProductID", "left")
             .withColumn("_most", F.lit(per_target) + F.coalesce("_owners", F.lit(0)))
             .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_most") - 1) / CAMPAIGN_BLOCK)))))
    found = asked.join(ranked, ["FamilyLevel1", "_block"]).filter(F.col("_frn") <= F.col("_most")).join(owners, ["ProductID", "ClientID"], "left_anti")
    return top_k(found, ["ProductID"], [F.col("_frn")], per_target).select("ProductID", "Rank", "ClientID", "PropensityScore", "DaysSinceLastPurchase")


def propensity_cross_sell_country(master: DataFrame, products: DataFrame, targets: DataFrame) -> DataFrame:
    """The same inside every store country at once: local scores, minus owners anywhere."""
    scores = propensity(affinity_matrix(master, by_country=True))
    fam = targets.select("ProductID").distinct().join(products.select("ProductID", "FamilyLevel1"), "ProductID")
    return _without_owners(fam, scores, _with_client(master).select("ProductID", "ClientID").distinct())


def last_purchase(master: DataFrame) -> DataFrame:
    """Last sale per client by (date, tie-break): product, family, country of that row. Only the sales of
    a client's last moment are joined to the dimensions, sorted and compared as rows."""
    tb = [c for c in row_tiebreak(master) if c not in ("ClientID", DATE)]
    order = F.struct(F.col(DATE), *[F.col(c) for c in tb])
    row = F.struct("ProductID", "FamilyLevel2", "ClientCountry", F.col(DATE).alias("LastDate"))
    return (at_moment(_with_client(master), "ClientID", F.max(DATE)).groupBy("ClientID").agg(F.max_by(row, order).alias("_r"))
            .select("ClientID", F.col("_r.ProductID").alias("LastProductID"),
                    F.col("_r.FamilyLevel2").alias("LastFamilyLevel2"),
                    F.col("_r.ClientCountry").alias("LastClientCountry"), F.col("_r.LastDate").alias("LastDate")))
