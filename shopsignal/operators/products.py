"""Product scoring: features and tiers, recency + seasonal trend, waterfall and diversity."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import day_delta, exact_mean, flag, ts_lit
from shopsignal.operators.features import AMOUNT, DATE, QTY, at_moment
from shopsignal.operators.numeric import exact_quantiles, materialize, top_k

TREND_KEYS = ["StoreID", "StoreCountry", "ProductID"]


def product_features(master: DataFrame) -> DataFrame:
    agg = master.filter(F.col("ProductID").isNotNull()).groupBy("ProductID").agg(
        F.countDistinct("ClientID").alias("ProductUniqueCustomers"),
        F.sum(AMOUNT).cast("double").alias("ProductTotalRevenue"),
        F.sum(QTY).cast("bigint").alias("ProductTotalUnitsSold"),
        F.count(F.lit(1)).alias("ProductTransactionCount"),
        F.min(DATE).alias("FirstSale"), F.max(DATE).alias("LastSale"))
    return (agg.withColumn("ProductDaysActive", day_delta("FirstSale", "LastSale"))
               .withColumn("ProductSalesVelocity",
                           F.col("ProductTotalUnitsSold") / F.greatest(F.col("ProductDaysActive"), F.lit(1)).cast("double")))


def product_tiers(pf: DataFrame, quantiles=exact_quantiles) -> DataFrame:
    """Top product / fast mover: strictly above the global 80th percentile (``quantiles``: exact, or ``sketches.approx_quantiles``)."""
    q = quantiles(pf, {"ProductTotalRevenue": [0.8], "ProductSalesVelocity": [0.8]})
    (rev80,), (vel80,) = q["ProductTotalRevenue"], q["ProductSalesVelocity"]
    return (pf.withColumn("IsTopProduct", flag(F.col("ProductTotalRevenue") > F.lit(rev80)))
              .withColumn("IsFastMover", flag(F.col("ProductSalesVelocity") > F.lit(vel80))))


def noise_filter(master: DataFrame, quantiles=exact_quantiles) -> DataFrame:
    """Drop unit prices below the global p10 and quantities above the global p99 (``quantiles`` as above)."""
    priced = master.withColumn("PricePerUnit", F.try_divide(F.col(AMOUNT).cast("double"), F.col(QTY).cast("double")))
    q = quantiles(priced, {"PricePerUnit": [K.NOISE_PRICE_Q], QTY: [K.NOISE_QTY_Q]})
    (floor,), (ceiling,) = q["PricePerUnit"], q[QTY]
    return priced.filter((F.col("PricePerUnit") >= F.lit(floor)) & (F.col(QTY) <= F.lit(ceiling)))


def trending_scores(master: DataFrame, target_date=None, filtered: DataFrame | None = None) -> DataFrame:
    """Per (store, country, product): recency score over the last 60 days (weight
    1/(1+0.1·days_ago)), seasonal score (units in the same quarter before the window),
    FinalScore = .7·recent + .3·seasonal, plus the product's last family and mean price.

    One pass of conditional sums replaces the outer join of the two windows.
    """
    if target_date is None:
        target_date = master.select(F.max(DATE)).first()[0]
    import datetime as _dt
    if target_date is None:                 # no sales: there is nothing to score, on any day
        target_date = _dt.datetime(1970, 1, 1)
    if isinstance(target_date, str):
        target_date = _dt.datetime.fromisoformat(target_date)
    cutoff = target_date - _dt.timedelta(days=K.TREND_WINDOW_DAYS)
    tq = (target_date.month - 1) // 3 + 1
    df = filtered if filtered is not None else noise_filter(master)
    d = F.col(DATE)
    t_lit = ts_lit(target_date)
    c_lit = ts_lit(cutoff)
    day_after = ts_lit(_dt.datetime(target_date.year, target_date.month, target_date.day) + _dt.timedelta(days=1))
    recent = (d >= c_lit) & (d < day_after)            # the whole target day counts
    seasonal = (F.quarter(d) == tq) & (d < c_lit)
    weight = 1.0 / (1.0 + day_delta(d, t_lit) * K.TREND_DECAY)
    scores = (df.filter(recent | seasonal).groupBy(*TREND_KEYS).agg(
        F.coalesce(F.sum(F.when(recent, weight)), F.lit(0.0)).alias("recent_score"),
        F.coalesce(F.sum(F.when(seasonal, F.col(QTY))), F.lit(0)).cast("double").alias("seasonal_score")))
    tb = [c for c in ("BasketID", "LineNo", "StoreID", "ClientID") if c in df.columns]
    sold = df.filter(F.col("ProductID").isNotNull())
    prices = sold.groupBy("ProductID").agg(exact_mean("PricePerUnit").alias("PricePerUnit"))
    # only the sales of a product's last moment are sorted and compared as rows
    families = at_moment(sold.filter(F.col("FamilyLevel1").isNotNull()), "ProductID", F.max(d)).groupBy("ProductID").agg(
        F.max_by("FamilyLevel1", F.struct(d, *[F.col(c) for c in tb])).alias("FamilyLevel1"))
    per_product = materialize(prices.join(families, "ProductID", "left"), "products-sold")     # their shuffles are gone before the scores'
    out = scores.join(per_product, "ProductID", "left")
    return (out.withColumn("FamilyLevel1", F.coalesce("FamilyLevel1", F.lit(K.UNKNOWN)))
               .withColumn("PricePerUnit", F.coalesce("PricePerUnit", F.lit(0.0)))
               .withColumn("FinalScore", F.col("recent_score") * K.TREND_RECENT_WEIGHT
                           + F.col("seasonal_score") * K.TREND_SEASONAL_WEIGHT))


def global_trends(master: DataFrame, products: DataFrame, target_date=None, top: int = 100,
                  filtered: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Σ FinalScore per product, best first, with FamilyLevel2; top ``top`` (the feature)."""
    s = scores if scores is not None else trending_scores(master, target_date, filtered)
    g = s.groupBy("ProductID").agg(F.sum("FinalScore").alias("FinalScore"))
    top_rows = top_k(g, [], [F.round("FinalScore", 6).desc(), F.col("ProductID")], top)
    return top_rows.join(products.select("ProductID", "FamilyLevel2"), "ProductID", "left")


def _diverse_top(c: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Best row per (keys, family) skipping Unknown — an aggregate (partial, skew-safe) —
    then the top ``n`` families per keys on the per-family table."""
    best_key = F.struct((-F.round("FinalScore", 6)).alias("s"), "StoreID", "StoreCountry", "ProductID")
    row = F.struct("ProductID", "PricePerUnit", "FinalScore", F.col("StoreID").alias("_sid"),
                   F.col("StoreCountry").alias("_sc"))
    best = (c.filter(F.col("FamilyLevel1") != K.UNKNOWN).groupBy(*keys, "FamilyLevel1")
             .agg(F.min_by(row, best_key).alias("_b"))
             .select(*keys, "FamilyLevel1", "_b.*"))
    order = [F.round("FinalScore", 6).desc(), F.col("_sid"), F.col("_sc"), F.col("ProductID")]
    return top_k(best, keys, order, n)


def store_trending_recs(scores: DataFrame, stores: DataFrame, top_n: int = 5) -> DataFrame:
    """For every store: store-level list if Σ score ≥ 10, else its country's if that
    Σ ≥ 10, else the global list; one product per family, top ``top_n``."""
    st = stores.select("StoreID", "StoreCountry").distinct()
    store_sum = scores.groupBy("StoreID").agg(F.sum("FinalScore").alias("_ss"))
    country_sum = scores.groupBy("StoreCountry").agg(F.sum("FinalScore").alias("_cs"))
    lvl = (st.join(store_sum, "StoreID", "left").join(country_sum, "StoreCountry", "left")
             .withColumn("Source", F.when(F.coalesce("_ss", F.lit(0.0)) >= K.WATERFALL_MIN_SCORE, "Store Level")
                         .when(F.coalesce("_cs", F.lit(0.0)) >= K.WATERFALL_MIN_SCORE, "Country Level")
                         .otherwise("Global Level"))
             .select("StoreID", F.col("StoreCountry").alias("TargetCountry"), "Source"))
    cols = ["Rank", "ProductID", "FamilyLevel1", "PricePerUnit", "FinalScore"]
    lvl_cols = ["StoreID", "TargetCountry", "Source"]
    s_top = _diverse_top(scores, ["StoreID"], top_n).select(F.col("StoreID").alias("_k"), *cols)
    c_top = _diverse_top(scores, ["StoreCountry"], top_n).select(F.col("StoreCountry").alias("_k"), *cols)
    g_top = _diverse_top(scores, [], top_n).select(*cols)
    a = (lvl.filter(F.col("Source") == "Store Level").withColumn("_k", F.col("StoreID"))
            .join(s_top, "_k").select(*lvl_cols, *cols))
    b = (lvl.filter(F.col("Source") == "Country Level").withColumn("_k", F.col("TargetCountry"))
            .join(c_top, "_k").select(*lvl_cols, *cols))
    # the global list has at most top_n rows: it travels as one scalar array, exploded per store
    g_list = g_top.agg(F.collect_list(F.struct(*cols))).scalar()
    c = (lvl.filter(F.col("Source") == "Global Level").select(*lvl_cols, F.explode(g_list).alias("_g"))
            .select(*lvl_cols, *[F.col(f"_g.{x}").alias(x) for x in cols]))
    return a.unionByName(b).unionByName(c)
