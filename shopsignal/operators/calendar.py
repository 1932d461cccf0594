"""Event calendar as a table: an interval join by bins of days.

``sporting_event_flag`` compiles a handful of events into a predicate; a calendar of any size is
joined here. An event is exploded to the bins of days that it touches and to its countries, a sale has one bin,
so the join is an equi-join on (bin, country), and the exact interval is the check behind it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignal.functions.scalar import flag
from shopsignal.operators.features import DATE

ALL = "All"
BIN_DAYS = 7
EPOCH = "1970-01-01"


def _bin(date: Column, days: int) -> Column:
    return F.floor(F.datediff(F.to_date(date), F.lit(EPOCH).cast("date")) / F.lit(days)).cast("int")


def binned(events: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """Events (EventID, start, end, countries) as one row per bin and country; ``All`` stands alone where it is listed.

    NULL bounds, an end before the start and empty or NULL country lists match nothing.
    """
    e = events.select("EventID", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
                      F.array_distinct(F.filter("countries", lambda c: c.isNotNull())).alias("countries")).filter(F.col("start") <= F.col("end"))
    where = F.when(F.array_contains("countries", ALL), F.array(F.lit(ALL))).otherwise(F.col("countries"))
    bins = F.sequence(_bin(F.col("start"), bin_days), _bin(F.col("end"), bin_days))
    return e.withColumn("_bin", F.explode(bins)).withColumn("_where", F.explode(where)).select("EventID", "start", "end", "_bin", "_where")


def event_matches(sales: DataFrame, events: DataFrame, country_col: str = "ClientCountry", bin_days: int = BIN_DAYS) -> DataFrame:
    """(moment, country, Events, FirstEvent) for every distinct sale moment and country inside an event: how many events, and the
    smallest EventID. Sales of one moment and country are asked once, so a rush of sales is one row of the join."""
    asked = sales.select(F.col(DATE).alias("_moment"), F.col(country_col).alias("_country")).filter(F.col("_moment").isNotNull()).distinct()
    # a country that calls itself All asks once
    wheres = F.array_distinct(F.filter(F.array(F.lit(ALL), F.col("_country")), lambda c: c.isNotNull()))
    probes = asked.withColumn("_bin", _bin(F.col("_moment"), bin_days)).withColumn("_where", F.explode(wheres))
    hit = probes.join(binned(events, bin_days), ["_bin", "_where"]).filter((F.col("_moment") >= F.col("start")) & (F.col("_moment") <= F.col("end")))
    return hit.groupBy("_moment", "_country").agg(F.count(F.lit(1)).alias("Events"), F.min("EventID").alias("FirstEvent"))


def add_calendar_events(sales: DataFrame, events: DataFrame, country_col: str = "ClientCountry", bin_days: int = BIN_DAYS) -> DataFrame:
    """``sales`` with Events (how many cover the sale's moment in the client's country), FirstEvent and IsMajorSportingEvent.

    Bounds are inclusive; an event for ``All`` covers every country and clients without one. Spark broadcasts
    either side of the join only where its measured size is below the threshold.
    """
    m = event_matches(sales, events, country_col, bin_days)
    out = sales.join(m, (F.col(DATE) == F.col("_moment")) & F.col(country_col).eqNullSafe(F.col("_country")), "left").drop("_moment", "_country")
    return out.withColumn("Events", F.coalesce("Events", F.lit(0)).cast("long")).withColumn("IsMajorSportingEvent", flag(F.col("Events") > 0))


def calendar_table(spark, events: Sequence[tuple]) -> DataFrame:
    """A calendar of (start, end, countries) as a table, numbered from 0."""
    rows = [(i, str(a), str(b), list(c)) for i, (a, b, c) in enumerate(events)]
    return spark.createDataFrame(rows, "EventID long, start string, end string, countries array<string>").select(
        "EventID", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "countries")
