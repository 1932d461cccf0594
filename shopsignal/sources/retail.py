"""Retail inputs: the five tables of the application, from CSV/parquet or the driver tables.

The driver tables (TPC-H-like star) are mapped onto the retail model by the views below
(see FIXTURES.md §2); every mapping is a projection/join that Catalyst prunes and pushes
down into the parquet scan.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.functions.scalar import ts_lit
from shopsignal.operators.numeric import sized
from shopsignal.session import default_partitions
from shopsignal.sources import schemas


@dataclass
class RetailTables:
    transactions: DataFrame   # ClientID, ProductID, StoreID, SaleTransactionDate, SalesNetAmountEuro, Quantity, BasketID?, LineNo?
    clients: DataFrame
    products: DataFrame
    stores: DataFrame
    stocks: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


DATE_SHIFT_YEARS = 23   # fixture sale date = o_orderdate + 23 years (FIXTURES.md §2)


def fixture_transactions(spark: SparkSession, sf_dir: str, since=None) -> DataFrame:
    """The sales view. ``since`` (a datetime) restricts sale dates; the view translates it
    into a predicate on the base column so it reaches the orders scan (Catalyst cannot
    invert the date shift by itself)."""
    # joined on the basket id itself: sales then lie by BasketID, and a full-row dedupe needs no second exchange
    li = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("BasketID"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = sized(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("_order"), "o_custkey", "o_orderdate"))
    if since is not None:
        base_since = since.replace(year=since.year - DATE_SHIFT_YEARS)
        o = o.filter(F.col("o_orderdate") >= ts_lit(base_since))
    j = li.join(o, F.col("BasketID") == F.col("_order"))
    return j.select(
        F.col("o_custkey").cast("string").alias("ClientID"),
        F.col("l_partkey").cast("string").alias("ProductID"),
        F.col("l_suppkey").cast("string").alias("StoreID"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 23 YEAR")).alias("SaleTransactionDate"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("SalesNetAmountEuro"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        "BasketID",
        F.col("l_linenumber").alias("LineNo"),
    )


def fixture_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        k.cast("string").alias("ClientID"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "LOYAL")
         .when(F.col("c_mktsegment") == "BUILDING", "TOP")
         .when(F.col("c_mktsegment") == "FURNITURE", "INACTIVE_1Y")
         .when(F.col("c_mktsegment") == "HOUSEHOLD", "PROSPECT").alias("ClientSegment"),
        F.col("n_name").alias("ClientCountry"),
        F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").alias("ClientGender"),
        (k % 2).cast("int").alias("ClientOptINEmail"),
        F.when(k % 5 < 2, 1).otherwise(0).alias("ClientOptINPhone"),
    )


def fixture_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("ProductID"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("Category"),
        F.col("p_brand").alias("FamilyLevel1"),
        F.col("p_name").alias("FamilyLevel2"),
        F.when(F.col("p_size") % 3 == 0, "Men").when(F.col("p_size") % 3 == 1, "Women").alias("Universe"),
    )


def fixture_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").cast("string").alias("StoreID"), F.col("n_name").alias("StoreCountry"))


GRID_PARTS = 10_000   # parts that a task multiplies by the nations


def fixture_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock grid country × product: every part meets the 25 rows of the nation dimension.

    A join, not an exploded array: the optimizer does not count the rows that an explode makes, and would take the
    grid for a table of the size of ``part`` and broadcast it. A nation stocks the parts of three of the four remainders
    by 4, so the join is one on the remainder. Parts are few bytes in few files, so they are
    dealt to all tasks before they are multiplied: to as many as keep GRID_PARTS parts each, and by ProductID, so that
    what is grouped by product (and country) needs no exchange of the grid."""
    parts = _read(spark, sf_dir, "part")
    n_tasks = max(default_partitions(spark), -(-parts.count() // GRID_PARTS))
    p = parts.select("p_partkey", F.col("p_partkey").cast("string").alias("ProductID")).repartition(n_tasks, "ProductID")
    stocked = F.filter(F.array(*[F.lit(r).cast("bigint") for r in range(4)]), lambda r: (r + F.col("n_nationkey")) % 4 != 0)
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(stocked).alias("_remainder"))
    g = p.join(F.broadcast(n), F.pmod(F.col("p_partkey").cast("bigint"), F.lit(4).cast("bigint")) == F.col("_remainder"))
    v = (F.col("p_partkey") * 7 + F.col("n_nationkey") * 13) % 50
    return g.select(
        F.col("n_name").alias("StoreCountry"),
        "ProductID",
        F.when(v < 10, 0).otherwise(v).cast("int").alias("Quantity"),
    )


def load_retail(spark: SparkSession, sf_dir: str, since=None) -> RetailTables:
    """The five retail tables as views over the driver's parquet tables."""
    return RetailTables(
        transactions=fixture_transactions(spark, sf_dir, since),
        clients=fixture_clients(spark, sf_dir),
        products=fixture_products(spark, sf_dir),
        stores=fixture_stores(spark, sf_dir),
        stocks=fixture_stocks(spark, sf_dir),
    )


def load_retail_csv(spark: SparkSession, folder: str) -> RetailTables:
    """The application's own CSV layout: columns bound by header name, in any order; ids are
    strings, dates parsed leniently; optional columns (see ``schemas.OPTIONAL``) may be missing."""
    def csv(name, schema):
        path = f"{folder.rstrip('/')}/{name}.csv"
        return schemas.select_by_name(spark.read.option("header", True).csv(path), schema, name)
    return RetailTables(
        transactions=schemas.parse_sale_dates(csv("transactions", schemas.TRANSACTIONS_CSV)),
        clients=csv("clients", schemas.CLIENTS_CSV),
        products=csv("products", schemas.PRODUCTS_CSV),
        stores=csv("stores", schemas.STORES_CSV),
        stocks=csv("stocks", schemas.STOCKS_CSV),
    )
