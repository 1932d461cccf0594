"""CSV inputs and outputs, plain or compressed: columns bound by header name, broken lines kept aside.

A table is ``<folder>/<name>.csv``, ``<name>.csv.gz`` or a folder ``<name>`` of such files, all with the same header. A
compressed file is one task's work, whatever its size: keep large tables as many files (``write_csv`` does).
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignal.sources import schemas
from shopsignal.sources.retail import RetailTables

LINE = "_line"          # of a broken line: the line itself; null for the others
INPUTS = {"transactions": schemas.TRANSACTIONS_CSV, "clients": schemas.CLIENTS_CSV, "products": schemas.PRODUCTS_CSV,
          "stores": schemas.STORES_CSV, "stocks": schemas.STOCKS_CSV}


def find(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of a table's files, or None."""
    for path in (f"{folder.rstrip('/')}/{name}{end}" for end in (".csv", ".csv.gz", "")):
        try:
            spark.read.text(path)
            return path
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header as text, and ``_line``: the whole line where it has too few or too many fields.

    The header is read first (one line), so every later scan has an explicit schema; files whose header differs
    from it raise an error. Every scan parses whole lines, whatever columns are used, so that all of them agree
    on which lines are broken. Empty files and folders without a header have no columns but ``_line``.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(LINE, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE)
            .option("enforceSchema", False).option("columnPruning", False).option("escape", '"').csv(path))


@dataclass
class CsvTable:
    rows: DataFrame       # typed by the wanted schema; text that does not cast is NULL
    broken: DataFrame     # (line, read) of the lines with too few or too many fields, and how many values were read


def read_csv(spark: SparkSession, folder: str, name: str, schema: T.StructType, optional: bool = False) -> CsvTable:
    """One table by its header's names. A missing table is an error, or without rows if ``optional``."""
    path = find(spark, folder, name)
    if path is None:
        if not optional:
            raise FileNotFoundError(f"no {name}.csv, {name}.csv.gz or folder {name} in {folder}")
        return CsvTable(spark.createDataFrame([], schema), spark.createDataFrame([], "line string, read int"))
    lines = read_lines(spark, path)
    names = [c for c in lines.columns if c != LINE]
    # Spark refuses a scan of nothing but the broken lines' column (a count, say), so the filter names another one
    whole = F.col(LINE).isNull() & (F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0) if names else F.col(LINE).isNull()
    good = lines.filter(whole).drop(LINE)
    return CsvTable(schemas.select_by_name(good, schema, name), lines.filter(f"{LINE} is not null").select(
        F.col(LINE).alias("line"), F.size(F.filter(F.array(*[F.col(f"`{c}`") for c in names]), lambda v: v.isNotNull())).alias("read")))


@dataclass
class RetailCsv:
    tables: RetailTables
    broken: DataFrame = field(repr=False)      # (table, line, read)


def read_retail(spark: SparkSession, folder: str) -> RetailCsv:
    """The five inputs from CSV files, and the broken lines of all of them."""
    found = {name: read_csv(spark, folder, name, schema) for name, schema in INPUTS.items()}
    broken = None
    for name, t in found.items():
        own = t.broken.selectExpr(f"'{name}' as `table`", "line", "read")
        broken = own if broken is None else broken.unionByName(own)
    rows = {name: t.rows for name, t in found.items()}
    rows["transactions"] = schemas.parse_sale_dates(rows["transactions"])
    return RetailCsv(RetailTables(**rows), broken)


def write_csv(df: DataFrame, folder: str, name: str, compression: str = "gzip", mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """A table as a folder of CSV files with a header each; quotes are doubled inside quoted fields."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("compression", compression)
       .option("maxRecordsPerFile", rows_per_file).csv(f"{folder.rstrip('/')}/{name}"))


def read_precomputed(spark: SparkSession, folder: str, schemas_by_name: dict[str, T.StructType | str], optional: set[str] = frozenset({"country_trending"})) -> dict[str, DataFrame]:
    """Precomputed tables from (gzip) CSV files by name; those of ``optional`` may be missing and are then empty."""
    out = {}
    for name, schema in schemas_by_name.items():
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        out[name] = read_csv(spark, folder, name, schema, optional=name in optional).rows
    return out
