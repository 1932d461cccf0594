"""Every query that SQL can express, against DuckDB on the smallest tables."""
import duckdb
import pandas as pd
import pytest

from shopsignal.llm.queries import QUERIES
from shopsignal.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    pd.testing.assert_frame_equal(want[cols].sort_values(cols).reset_index(drop=True),
                                  got[cols].sort_values(cols).reset_index(drop=True), check_dtype=False)
