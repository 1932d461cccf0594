"""Micro-fixtures for cleaning, calendar, events, price and gap features."""
import datetime as dt

from pyspark.sql import functions as F

from shopsignal.functions.scalar import black_friday, day_delta
from shopsignal.operators import cleaning, features


def test_black_friday_dates(spark):
    df = spark.createDataFrame([(y,) for y in (2019, 2022, 2023, 2024)], "y int")
    got = [r.d for r in df.select(black_friday(F.col("y")).alias("d")).orderBy("y").collect()]
    assert got == [dt.date(2019, 11, 22), dt.date(2022, 11, 25), dt.date(2023, 11, 24), dt.date(2024, 11, 22)]


def test_cyber_monday_boundaries(make_tx):
    tx = make_tx([{"date": "2024-11-25 00:00:00"}, {"date": "2024-11-25 10:00:00"}, {"date": "2024-11-22 09:00:00"}])
    out = features.add_retail_events(features.add_calendar(tx)).orderBy("SaleTransactionDate").collect()
    assert [(r.IsBlackFriday, r.IsCyberMonday) for r in out] == [(1, 0), (1, 1), (0, 0)]


def test_day_delta_floors_elapsed_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(day_delta("a", "b").alias("d")).first().d == 0


def test_days_since_last_first_purchase_is_9999(make_tx):
    tx = make_tx([{"date": "2024-01-01 00:00:00"}, {"date": "2024-01-11 00:00:00"}, {"ClientID": "c2", "date": "2024-01-05 00:00:00"}])
    out = {(r.ClientID, r.SaleTransactionDate.day): r.DaysSinceLastPurchase
           for r in features.add_days_since_last(tx).collect()}
    assert out == {("c1", 1): 9999, ("c1", 11): 10, ("c2", 5): 9999}


def test_clean_filters_and_dedupes(make_tx):
    tx = make_tx([{"amount": "5", "qty": 1, "BasketID": "x", "LineNo": 1}, {"amount": "5", "qty": 1, "BasketID": "x", "LineNo": 1},
                  {"amount": "-1", "qty": 1}, {"amount": "3", "qty": 0}, {"amount": "3", "qty": 2, "date": None}])
    assert cleaning.clean_transactions(tx).count() == 1
    assert cleaning.quarantined(tx).count() == 1


def test_discount_premium_and_bulk_bounds(make_tx):
    rows = [{"ProductID": "p", "amount": a, "qty": q} for a, q in [("1", 1), ("1", 1), ("1", 1), ("4", 4), ("5", 5), ("10", 1)]]
    out = {(r.ProductID, r.Quantity, float(r.SalesNetAmountEuro)): r for r in features.add_price_features(make_tx(rows)).collect()}
    assert out[("p", 4, 4.0)].IsBulkPurchase == 0 and out[("p", 5, 5.0)].IsBulkPurchase == 1   # median 1 → max(3, 5)
    hi = out[("p", 1, 10.0)]
    assert hi.DiscountPercentage == 0.0 and hi.IsPremiumPurchase == 1      # price above the average
    lo = out[("p", 1, 1.0)]
    assert lo.IsPotentialDiscount == 1 and 0 < lo.DiscountPercentage < 100


def test_discount_avg_zero_is_full(make_tx):
    rows = [{"ProductID": "z", "amount": "0", "qty": 1}, {"ProductID": "z", "amount": "0", "qty": 2}]
    assert [r.DiscountPercentage for r in features.add_price_features(make_tx(rows)).collect()] == [100.0, 100.0]


def test_cross_border_null_country(spark):
    df = spark.createDataFrame([("A", None), ("A", "A"), ("A", "B")], "ClientCountry string, StoreCountry string")
    out = [(r.IsCrossBorder, r.IsLocalPurchase) for r in features.add_cross_border(df).collect()]
    assert out == [(1, 0), (0, 1), (1, 0)]


def test_sporting_event_inclusive_end_and_country(make_tx):
    tx = make_tx([{"date": "2022-12-18 00:00:00"}, {"date": "2022-12-18 10:00:00"}, {"date": "2023-02-12 00:00:00"},
                  {"date": "2023-02-12 00:00:00", "ClientID": "c2"}])
    tx = tx.withColumn("ClientCountry", F.when(F.col("ClientID") == "c1", "US").otherwise("FR"))
    got = [(r.ClientCountry, r.IsMajorSportingEvent)
           for r in features.add_sporting_events(tx).orderBy("SaleTransactionDate", "ClientID").collect()]
    assert got == [("US", 1), ("US", 0), ("US", 1), ("FR", 0)]


def test_days_since_last_without_a_client_is_9999(make_tx):
    tx = make_tx([{"ClientID": None, "date": "2024-01-01 00:00:00"}, {"ClientID": None, "date": "2024-01-05 00:00:00"}])
    tx = tx.selectExpr("nullif(ClientID, 'c1') AS ClientID", "* EXCEPT (ClientID)")
    assert {r.DaysSinceLastPurchase for r in features.add_days_since_last(tx).collect()} == {9999}
