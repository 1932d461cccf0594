import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("shopsignal-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s


TX_SCHEMA = ("ClientID string, ProductID string, StoreID string, SaleTransactionDate timestamp_ntz, "
             "SalesNetAmountEuro decimal(18,2), Quantity int, BasketID string, LineNo int")


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_tx(spark):
    from decimal import Decimal

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            r = dict(r)
            out.append((r.get("ClientID", "c1"), r.get("ProductID", "p1"), r.get("StoreID", "s1"),
                        ts(r.get("date", "2024-01-01 00:00:00")) if r.get("date", "x") is not None else None,
                        Decimal(str(r.get("amount", "10.00"))), r.get("qty", 1),
                        r.get("BasketID", f"b{i}"), r.get("LineNo", i)))
        return spark.createDataFrame(out, TX_SCHEMA)
    return make
