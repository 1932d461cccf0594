"""The wide per-sale feature table: star join, calendar, events, prices, gaps, Pareto."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import as_ts, black_friday, day_delta, exact_mean, flag, season
from shopsignal.operators import cleaning
from shopsignal.operators.numeric import grouped_quantile, ordered_scan

DATE, AMOUNT, QTY = cleaning.DATE, cleaning.AMOUNT, cleaning.QTY
PRODUCT_COLS = ["ProductID", "Category", "FamilyLevel1", "FamilyLevel2", "Universe"]
CLIENT_COLS = ["ClientID", "ClientSegment", "ClientCountry", "ClientGender", "HasEmail", "HasPhone", "HasContact"]


def row_tiebreak(df: DataFrame) -> list[str]:
    """Columns that, after full-row dedupe, totally order sales sharing a date/amount."""
    cols = ["BasketID", "LineNo", "ProductID", "StoreID", AMOUNT, QTY, "ClientID", DATE]
    return [c for c in cols if c in df.columns]


def at_moment(sales: DataFrame, key: str, moment) -> DataFrame:
    """The sales at their key's ``moment``, an aggregate of DATE (its latest, say). The semi-join goes below the joins of a lazy view."""
    moments = sales.groupBy(F.col(key).alias("_of")).agg(moment.alias("_at"))
    return sales.join(moments, (F.col(key) == F.col("_of")) & F.col(DATE).eqNullSafe(F.col("_at")), "left_semi")


def master_join(tx: DataFrame, products: DataFrame, clients: DataFrame, stores: DataFrame) -> DataFrame:
    """Sales ⟕ products ⟕ clients ⟕ stores on pruned columns (NULL keys never match).

    Each dimension is made unique on its key (of repeated keys the row with the least columns, from
    left to right, NULL first), so the fact side never fans out and Catalyst drops every join none of
    whose columns a query uses. AQE turns the rest into broadcast joins when
    the measured size is under the threshold and keeps shuffle joins otherwise; there, sales
    without a key are spread by a hash of their amount instead of meeting in one task.
    """
    out = tx
    for dim, key in ((products.select(*PRODUCT_COLS), "ProductID"), (clients.select(*CLIENT_COLS), "ClientID"),
                     (stores.select("StoreID", "StoreCountry"), "StoreID")):
        side = one_row_per_key(dim, key).withColumnRenamed(key, "_key")
        out = out.join(side, spread_key(key) == F.col("_key"), "left").drop("_key")
    return out


def spread_key(key: str):
    """The join key of sales: ``key``, or where that is NULL a hash of their amount that meets no row."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.xxhash64(AMOUNT).cast("string")))


def one_row_per_key(dim: DataFrame, key: str) -> DataFrame:
    """Of the rows that share a key the one with the least other columns, from left to right, NULL first: always the same one."""
    others = [c for c in dim.columns if c != key]
    return dim.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def add_calendar(df: DataFrame) -> DataFrame:
    d = F.col(DATE)
    month, quarter, dow = F.month(d), F.quarter(d), F.weekday(d)
    cols = {"Year": F.year(d), "Month": month, "Quarter": quarter, "DayOfWeek": dow,
            "DayOfMonth": F.dayofmonth(d), "IsWeekend": dow.isin(5, 6).cast("int"), "Season": season(month)}
    for s in ("Winter", "Spring", "Summer", "Fall"):
        cols[f"Is{s}"] = (season(month) == s).cast("int")
    for q in (1, 2, 3, 4):
        cols[f"IsQ{q}"] = (quarter == q).cast("int")
    return df.withColumns(cols)


def add_retail_events(df: DataFrame, us_thanksgiving: bool = False) -> DataFrame:
    """Black Friday window [bf, bf+3d] (Monday 00:00 included), Cyber Monday at bf+3d 00:00,
    fixed seasonal windows and IsHoliday. Black Friday is the fourth Friday of November; with
    ``us_thanksgiving`` the day after its fourth Thursday (a week later where the month starts on a Friday)."""
    d = F.col(DATE)
    year = F.year(d)
    bf = as_ts(black_friday(year, us_thanksgiving))
    cm = as_ts(F.date_add(black_friday(year, us_thanksgiving), 3))
    m, dom = F.month(d), F.dayofmonth(d)
    black = flag((d >= bf) & (d <= cm))
    xmas = flag((m == 12) & (dom <= 25))
    newyear = flag(((m == 12) & (dom >= 26)) | ((m == 1) & (dom <= 7)))
    weekend = F.weekday(d).isin(5, 6)
    return df.withColumns({
        "IsBlackFriday": black, "IsCyberMonday": flag(d == cm), "IsChristmasSeason": xmas,
        "IsNewYearSeason": newyear,
        "IsBackToSchool": flag(((m == 8) & (dom >= 15)) | ((m == 9) & (dom <= 15))),
        "IsSummerSale": flag(((m == 6) & (dom >= 15)) | (m == 7)),
        "IsHoliday": flag(weekend | (xmas == 1) | (newyear == 1) | (black == 1)),
    })


def sporting_event_flag(events=K.SPORTING_EVENTS, country_col: str = "ClientCountry"):
    """Inclusive interval match against a small event calendar, compiled to one predicate.

    The calendar is a parameter of a handful of rows, so an OR of range tests (codegen'd,
    no join) is cheaper than a broadcast range join.
    """
    d = F.col(DATE)
    cond = F.lit(False)
    for start, end, countries in events:
        hit = (d >= F.lit(start).cast("timestamp_ntz")) & (d <= F.lit(end).cast("timestamp_ntz"))
        if "All" not in countries:
            hit = hit & F.col(country_col).isin(*countries)
        cond = cond | hit
    return flag(cond)


def add_sporting_events(df: DataFrame, events=K.SPORTING_EVENTS) -> DataFrame:
    return df.withColumn("IsMajorSportingEvent", sporting_event_flag(events))


def add_price_features(df: DataFrame) -> DataFrame:
    """Unit price, product average price, discount/premium flags, typical quantity, bulk flag.

    One aggregate per product and the exact grouped median of its quantities, joined back.
    """
    with_price = df.withColumn("PricePerUnit", F.col(AMOUNT).cast("double") / F.greatest(F.col(QTY), F.lit(1)))
    sold = with_price.filter(F.col("ProductID").isNotNull())
    per_product = (sold.groupBy("ProductID").agg(exact_mean("PricePerUnit").alias("AvgPricePerUnit"))
                   .join(grouped_quantile(sold, ["ProductID"], QTY, 0.5, "TypicalQuantity"), "ProductID", "left"))
    p, avg = F.col("PricePerUnit"), F.col("AvgPricePerUnit")
    disc = (1 - p / F.greatest(avg, F.lit(0.01))) * 100
    return (with_price.join(per_product, "ProductID", "left")
            .withColumn("IsPotentialDiscount", flag(p < avg * 0.8))
            .withColumn("DiscountPercentage", F.least(F.greatest(disc, F.lit(0.0)), F.lit(100.0)))
            .withColumn("IsPremiumPurchase", flag(p > avg * 1.2))
            .withColumn("IsBulkPurchase", flag(F.col(QTY) >= F.greatest(F.col("TypicalQuantity") * 3, F.lit(5)))))


def add_cross_border(df: DataFrame) -> DataFrame:
    local = flag(F.col("StoreCountry") == F.col("ClientCountry"))
    return df.withColumn("IsLocalPurchase", local).withColumn("IsCrossBorder", 1 - F.col("IsLocalPurchase"))


def add_by_row_key(df: DataFrame, add) -> DataFrame:
    """The columns that ``add`` gives to sales, for rows of any width: ``add`` (ordered scans, which write what they
    order) sees the row key alone, and what it adds is joined back. Sales are unique on the row key."""
    key = row_tiebreak(df)
    slim = add(df.select(*key))
    new = [c for c in slim.columns if c not in key]
    found = slim.select(*[F.col(c).alias(f"_key_{c}") for c in key], *new)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return df.join(found, same, "left").drop(*[f"_key_{c}" for c in key])


def add_days_since_last(df: DataFrame) -> DataFrame:
    """Whole days since the client's previous sale (9999 for the first and without a client),
    skew-safe scan over the row key."""
    if set(df.columns) - set(row_tiebreak(df)):
        return add_by_row_key(df, add_days_since_last)
    tb = [c for c in row_tiebreak(df) if c not in ("ClientID", DATE)]
    scanned = ordered_scan(df.filter(F.col("ClientID").isNotNull()), ["ClientID"], [DATE, *tb],
                           lag_cols=[DATE], prefix="_g")
    gap = F.coalesce(day_delta(F.col(f"_gprev_{DATE}"), F.col(DATE)), F.lit(K.FIRST_PURCHASE_GAP))
    out = scanned.withColumn("DaysSinceLastPurchase", gap).drop("_grn", f"_gprev_{DATE}")
    return out.unionByName(df.filter(F.col("ClientID").isNull())
                           .withColumn("DaysSinceLastPurchase", F.lit(K.FIRST_PURCHASE_GAP).cast("bigint")))


def add_pareto(df: DataFrame) -> DataFrame:
    """Cumulative revenue in descending amount order (ties by the row tie-break); flag rows
    within 80 % of the total. Exact DECIMAL running sum from one range-partitioned scan over the row key."""
    if set(df.columns) - set(row_tiebreak(df)):
        return add_by_row_key(df, add_pareto)
    tb = [c for c in row_tiebreak(df) if c != AMOUNT]
    total = df.select(F.sum(AMOUNT)).scalar()
    share = F.lit(K.PARETO_SHARE).cast("decimal(2,1)")
    scanned = ordered_scan(df, [], [F.col(AMOUNT).desc(), *tb], sum_col=AMOUNT, prefix="_p")
    return (scanned.withColumnRenamed("_pcum", "CumulativeRevenue").drop("_prn")
            .withColumn("IsTop20PercentRevenue", flag(F.col("CumulativeRevenue") <= total * share)))
