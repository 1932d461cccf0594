"""Every key over a folder whose sale table is empty, and over one without any row at all."""
import os

import pytest

from shopsignal.plans.catalog import QUERIES, build_query

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


def folder(spark, root, empty):
    for t in TABLES:
        path = f"{root}/{t}.parquet"
        if t in empty:
            spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(path)
        else:
            os.symlink(f"{SF}/{t}.parquet", path)
    return str(root)


@pytest.fixture(scope="module")
def no_sales(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("sales"), {"lineitem"})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_without_sales(spark, no_sales, name):
    build_query(name, spark, no_sales).collect()


def test_without_any_row(spark, tmp_path):
    root = folder(spark, tmp_path, set(TABLES))
    for name in ("master_join", "rfm_scores", "trending_scores", "store_trending_recs", "recommendations", "assoc_rules_product", "propensity_cross_sell",
                 "search_terms", "calendar_events", "similar_products_lsh", "rule_audiences", "stock_pivot_wide", "country_refresh"):
        assert build_query(name, spark, root).count() == 0, name
