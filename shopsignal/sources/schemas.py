"""Explicit schemas of the five retail inputs bound by column name."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS_CSV = T.StructType([
    T.StructField("ClientID", T.StringType()),
    T.StructField("ProductID", T.StringType()),
    T.StructField("StoreID", T.StringType()),
    T.StructField("SaleTransactionDate", T.StringType()),   # parsed with try_cast, see parse_sale_dates
    T.StructField("SalesNetAmountEuro", T.DecimalType(18, 2)),
    T.StructField("Quantity", T.IntegerType()),
    T.StructField("BasketID", T.StringType()),
])
PRODUCTS_CSV = T.StructType([T.StructField(c, T.StringType()) for c in
                             ["ProductID", "Category", "FamilyLevel1", "FamilyLevel2", "Universe"]])
CLIENTS_CSV = T.StructType([
    T.StructField("ClientID", T.StringType()),
    T.StructField("ClientSegment", T.StringType()),
    T.StructField("ClientCountry", T.StringType()),
    T.StructField("ClientGender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("ClientOptINEmail", T.IntegerType()),
    T.StructField("ClientOptINPhone", T.IntegerType()),
])
STORES_CSV = T.StructType([T.StructField("StoreID", T.StringType()), T.StructField("StoreCountry", T.StringType())])
STOCKS_CSV = T.StructType([
    T.StructField("StoreCountry", T.StringType()),
    T.StructField("ProductID", T.StringType()),
    T.StructField("Quantity", T.IntegerType()),
])


def opt_col(df: DataFrame, name: str, default) -> Column:
    """``df[name]`` when the column exists, else a literal default (optional inputs)."""
    return F.col(name) if name in df.columns else F.lit(default)


#: columns a file may lack, and what stands for them: no basket id means that the column is left
#: out (baskets are then built from client, date and store); no opt-in means nobody opted in
OPTIONAL = {"BasketID": "drop", "Age": None, "ClientOptINEmail": 0, "ClientOptINPhone": 0}


def select_by_name(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """``df`` (all text) with the schema's columns by name, cast; a missing one that is not
    optional is an error. Text that does not cast becomes NULL."""
    cols = []
    for f in schema:
        if f.name in df.columns:
            cols.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
        elif f.name not in OPTIONAL:
            raise ValueError(f"{table} has no column {f.name}")
        elif OPTIONAL[f.name] != "drop":
            cols.append(F.lit(OPTIONAL[f.name]).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def parse_sale_dates(df: DataFrame, col: str = "SaleTransactionDate") -> DataFrame:
    """Text → TIMESTAMP_NTZ keeping wall time; unparseable → NULL (offsets are dropped)."""
    return df.withColumn(col, F.expr(f"try_cast(`{col}` AS TIMESTAMP_NTZ)"))
