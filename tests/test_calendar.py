"""The calendar join against every event on every sale."""
import datetime as dt
import random

from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.operators import calendar
from shopsignal.operators.features import DATE, sporting_event_flag


def day(s):
    return dt.datetime.fromisoformat(s)


def data(spark):
    rng = random.Random(4)
    base = day("2023-12-20 00:00:00")
    events = []
    for i in range(400):
        start = base + dt.timedelta(hours=rng.randrange(24 * 60), seconds=rng.choice([0, 1]))
        length = rng.choice([dt.timedelta(0), dt.timedelta(hours=5), dt.timedelta(days=3), dt.timedelta(days=400)])
        events.append((i, start, start + length, rng.choice([["FR"], ["DE", "FR", "FR"], ["All"], ["FR", "All"], [], None, [None, "IT"]])))
    events += [(400, None, base, ["All"]), (401, base, None, ["All"]), (402, base + dt.timedelta(days=2), base, ["All"])]
    sales = [(i, (base + dt.timedelta(hours=rng.randrange(-50, 24 * 60))) if i % 20 else None, rng.choice(["FR", "DE", "IT", "All", None])) for i in range(500)]
    sales += [(1000 + i, events[i][1], "FR") for i in range(50)] + [(2000 + i, events[i][2], "FR") for i in range(50)]       # on the bounds
    return (sales, events, spark.createDataFrame(sales, f"n int, {DATE} timestamp_ntz, ClientCountry string"),
            spark.createDataFrame(events, "EventID long, start timestamp_ntz, end timestamp_ntz, countries array<string>"))


def test_same_as_every_event_on_every_sale(spark):
    sales, events, s, e = data(spark)
    for days in (1, 7, 1000):
        got = {r.n: (r.Events, r.FirstEvent, r.IsMajorSportingEvent) for r in calendar.add_calendar_events(s, e, bin_days=days).collect()}
        assert len(got) == len(sales)
        for n, t, c in sales:
            hit = [i for i, a, b, w in events if t and a and b and a <= t <= b and w and ("All" in w or c in [x for x in w if x])]
            assert got[n] == (len(hit), min(hit, default=None), int(bool(hit))), (n, t, c)


def test_the_fixed_calendar_as_a_table(spark):
    days = spark.range(0, 900).select((F.lit("2022-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias(DATE))
    s = days.withColumn("ClientCountry", F.explode(F.array(*[F.lit(c) for c in ("FR", "US", "JP")])))
    both = calendar.add_calendar_events(s.withColumn("want", sporting_event_flag()), calendar.calendar_table(spark, K.SPORTING_EVENTS))
    assert both.filter("want <> IsMajorSportingEvent").count() == 0 and both.filter("want = 1").count() > 40


def test_no_nested_loop_at_any_size(spark):
    _, _, s, e = data(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", old):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = calendar.add_calendar_events(s, e)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "_where" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_tables(spark):
    _, _, s, e = data(spark)
    assert calendar.add_calendar_events(s, e.limit(0)).agg(F.sum("Events")).first()[0] == 0
    assert calendar.add_calendar_events(s.limit(0), e).count() == 0
