"""Oracle parity on the smallest scale: Spark query == DuckDB SQL (rows, columns, values)."""
import math

import duckdb
import pandas as pd
import pytest

from shopsignal.plans.catalog import build_query
from shopsignal.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings", "events"]
KEYS = sorted(ORACLE_SQL)


def _canon(df: pd.DataFrame):
    cols = sorted(df.columns)

    def c(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) if isinstance(v, float) else (v.item() if hasattr(v, "item") else v)
    rows = [tuple(c(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", KEYS)
def test_oracle_parity(spark, con, name):
    got = _canon(build_query(name, spark, SF).toPandas())
    exp = _canon(con.execute(ORACLE_SQL[name]).df())
    assert got[0] == exp[0]
    assert len(got[1]) == len(exp[1])
    assert got[1] == exp[1]
