"""The quarantine pass: reasons, counters, and what each side reads back."""
import datetime as dt
from decimal import Decimal

from shopsignal.operators import cleaning, quarantine

SCHEMA = "ClientID string, DateText string, SaleTransactionDate timestamp_ntz, SalesNetAmountEuro decimal(18,2), Quantity int"
DAY = dt.datetime(2024, 1, 1)


def rows():
    ok = ("2024-01-01", DAY)
    return [("ok", *ok, Decimal(5), 1), ("ok", *ok, Decimal(5), 1), ("ok", *ok, Decimal(0), 1), ("text", "nonsense", None, Decimal(-1), 0), ("none", None, None, Decimal(1), 1),
            ("amount", *ok, None, -1), ("minus", *ok, Decimal("-0.01"), None), ("qty", *ok, Decimal(1), None), ("zero", *ok, Decimal(1), 0)]


def test_reasons_counters_and_rows(spark, tmp_path):
    tx = spark.createDataFrame(rows(), SCHEMA)
    s = quarantine.split(tx, str(tmp_path / "q"), "DateText")
    assert s.counts == {"accepted": 3, "unparseable date": 1, "missing date": 1, "missing amount": 1, "negative amount": 1, "missing quantity": 1, "quantity not positive": 1}
    assert {r.ClientID: r.Reason for r in s.rejected.collect()} == {
        "text": "unparseable date", "none": "missing date", "amount": "missing amount", "minus": "negative amount", "qty": "missing quantity", "zero": "quantity not positive"}
    assert sorted(map(tuple, s.clean.collect())) == sorted(map(tuple, cleaning.valid_transactions(tx).collect()))
    # the rows set aside for their date are those of the plain filter
    dates = s.rejected.filter("Reason in ('unparseable date', 'missing date')")
    assert sorted(r.ClientID for r in dates.collect()) == sorted(r.ClientID for r in cleaning.quarantined(tx).collect())


def test_each_side_reads_its_own_part(spark, tmp_path):
    s = quarantine.split(spark.createDataFrame(rows(), SCHEMA), str(tmp_path / "q"))
    for df in (s.clean, s.rejected):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(Rejected" in plan
    assert s.counts["missing date"] == 2      # without the text nobody can say whether there was one


def test_empty_and_all_bad(spark, tmp_path):
    tx = spark.createDataFrame(rows(), SCHEMA)
    s = quarantine.split(tx.limit(0), str(tmp_path / "a"))
    assert s.clean.count() == s.rejected.count() == 0 and set(s.counts.values()) == {0}
    s = quarantine.split(tx.filter("ClientID <> 'ok'"), str(tmp_path / "b"))
    assert s.clean.count() == 0 and s.rejected.count() == 6 == cleaning.quarantined(tx).count() + 4
