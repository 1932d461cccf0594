"""Stored artefacts for use: refreshed country by country, and bucketed by client for point lookups."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.operators.numeric import shared_folder
from shopsignal.session import default_partitions

MAX_VALUES = 10_000      # distinct partition values (countries); more are an error, not a partitioning


# ------------------------------------------------------------------------------------------ refresh by country
@dataclass
class Refresh:
    rewritten: list        # partition values whose rows changed or are new
    removed: list          # values that have no row any more
    kept: list             # values whose files were left alone


def fingerprints(df: DataFrame, by: str) -> dict:
    """{value: (rows, sum, xor) of the rows' hashes}: equal for equal rows in any order; one aggregate, a row per value."""
    h = F.xxhash64(*[c for c in df.columns if c != by])
    rows = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("s"), F.bit_xor(h).alias("x")).limit(MAX_VALUES + 1).collect()
    if len(rows) > MAX_VALUES:
        raise ValueError(f"{by} has more than {MAX_VALUES} values")
    return {r[by]: (r["n"], r["s"], r["x"]) for r in rows}


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _stored(spark: SparkSession, folder: str) -> dict:
    if not _exists(spark, folder):
        return {}
    return {r["value"]: (r["n"], r["s"], r["x"]) for r in spark.read.parquet(folder).collect()}


def refresh(df: DataFrame, root: str, by: str = "StoreCountry", rows_per_file: int = 1_000_000) -> Refresh:
    """Bring the table at ``root``, partitioned by ``by``, up to ``df``, rewriting only values whose rows changed.

    Rows of a value are dealt by a hash to as many tasks as it needs files of ``rows_per_file`` rows, so a
    large country is written by many tasks and a small one makes one file. The write replaces the partitions
    that it holds (dynamic overwrite); the fingerprints are stored last, so a refresh that failed is done again.
    """
    spark = df.sparkSession
    new, old = fingerprints(df, by), _stored(spark, f"{root}-fingerprints")
    changed = [v for v in new if old.get(v) != new[v]]
    removed = [v for v in old if v not in new]
    if changed:
        files = F.create_map(*[x for v in changed if v is not None for x in (F.lit(v), F.lit(-(-new[v][0] // rows_per_file)))]) if any(v is not None for v in changed) else None
        n_files = F.coalesce(F.element_at(files, F.col(by)), F.lit(-(-new.get(None, (1,))[0] // rows_per_file))) if files is not None else F.lit(1)
        mine = F.col(by).isin(*[v for v in changed if v is not None])
        part = df.filter((mine | F.col(by).isNull()) if None in changed else mine)
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), n_files)
        total = sum(-(-new[v][0] // rows_per_file) for v in changed)
        (part.withColumn("_salt", salt).repartition(min(total, 20 * default_partitions(spark)), F.col(by), F.col("_salt")).drop("_salt")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(root))
    for v in removed:
        name = "__HIVE_DEFAULT_PARTITION__" if v is None else quote(str(v), safe=" !$&'()*+,-.;@_~")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{by}={name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if changed or removed:
        spark.createDataFrame([(v, *f) for v, f in new.items()], f"value {df.schema[by].dataType.simpleString()}, n long, s string, x long") \
             .coalesce(1).write.mode("overwrite").parquet(f"{root}-fingerprints")
    return Refresh(changed, removed, [v for v in new if v not in changed])


def read_by_country(spark: SparkSession, root: str, schema, by: str = "StoreCountry") -> DataFrame:
    """The table at ``root``; a filter on ``by`` reads that country's files alone. A table that no refresh gave a row is empty."""
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root)


# ------------------------------------------------------------------------------------------ bucketed by client
def store_bucketed(tables: dict[str, DataFrame], prefix: str, key: str = "ClientID", buckets: int | None = None, folder: Callable[[str], str] | None = None) -> dict[str, str]:
    """Save each table bucketed and sorted by ``key`` and return the saved tables' names.

    All have the same number of buckets, so joins between them on ``key`` need no exchange, and a lookup of one
    client reads one bucket (and there, by the sort, few row groups). Files lie in the shared folder.
    """
    out = {}
    for name, df in tables.items():
        spark = df.sparkSession
        n = buckets or default_partitions(spark)
        out[name] = f"{prefix}_{name}"
        path = folder(name) if folder else shared_folder(spark, f"bucketed-{name}")
        # one task a bucket, so that a bucket is one sorted file
        (df.repartition(n, key).write.mode("overwrite").format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(out[name]))
    return out


def lookup(spark: SparkSession, table: str, client: str, key: str = "ClientID") -> DataFrame:
    return spark.table(table).filter(F.col(key) == F.lit(client))


def client_page(spark: SparkSession, tables: dict[str, str], client: str | None = None) -> DataFrame:
    """A client's page: features with the recommendation cards, from stored tables, for every client or one."""
    features, cards = spark.table(tables["client_features"]), spark.table(tables["recommendation_cards"])
    page = features.join(cards, "ClientID", "left")
    return page if client is None else page.filter(F.col("ClientID") == F.lit(client))
