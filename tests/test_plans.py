"""Physical-plan checks: pruning/pushdown at the scan, no row-at-a-time Python, skew-safe scans."""
import re

import pytest

from shopsignal.plans.catalog import QUERIES, build_query

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["country_kpis", "rfm_scores", "recommendations", "assoc_rules_family",
                                  "markov_transitions", "client_360", "store_trending_recs"])
def test_no_python_udf_in_plan(spark, name):
    p = plan(build_query(name, spark, SF))
    assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow"))


def test_query_reads_and_joins_only_what_it_uses(spark):
    """Revenue by country scans two columns of the clean sales and joins the stores alone."""
    df = build_query("revenue_by_country", spark, SF)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Join ") == 2                                  # stores, and nations inside the store view
    assert "p_partkey" not in p and "c_custkey" not in p and "InMemoryRelation" not in p
    scan = next(x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "clean-sales" in x)
    assert set(re.findall(r"(\w+):", scan.split("ReadSchema: struct<")[1])) == {"StoreID", "SalesNetAmountEuro"} or \
        re.search(r"FileScan parquet \[StoreID#\d+,SalesNetAmountEuro#\d+\]", scan)


@pytest.mark.parametrize("name", ["pareto_revenue", "days_since_last", "markov_transitions", "rfm_scores", "country_kpis"])
def test_no_window_orders_all_rows_in_one_task(spark, name):
    """A window without partition keys only ever ranks one row per range partition, or k rows."""
    p = plan(build_query(name, spark, SF))
    for line in p.splitlines():
        if re.search(r"Window \[.*windowspecdefinition\((?!_scan_pid|_last|[A-Za-z_]+#\d+, )", line):
            assert "_scan_pid" in line


def test_every_query_has_a_builder_and_oracle_keys_exist():
    from shopsignal.plans.oracle import ORACLE_SQL
    assert set(ORACLE_SQL) <= set(QUERIES)
    missing = set(QUERIES) - set(ORACLE_SQL)
    assert missing == {"prod2vec_vectors", "similar_products_lsh"}


@pytest.mark.parametrize("name", ["store_trending_recs", "recommendations", "overstock", "bundle_products",
                                  "country_insights", "category_country_matrix", "stock_pivot", "dataset_metadata"])
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(build_query(name, spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
