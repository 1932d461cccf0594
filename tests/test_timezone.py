"""Results must not depend on the session time zone (the driver's session may not be UTC)."""
import datetime as dt

from shopsignal.functions.scalar import day_delta, ts_lit


def test_day_delta_and_literals_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame(
            [(dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 10, 12)),      # across the DST change
             (dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1)),
             (dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 1, 12))],
            "a timestamp_ntz, b timestamp_ntz")
        assert [r.d for r in df.select(day_delta("a", "b").alias("d")).collect()] == [1, 0, -1]
        v = spark.range(1).select(ts_lit(dt.datetime(2024, 3, 10, 2, 30)).alias("t")).first().t
        assert v == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
