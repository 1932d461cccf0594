"""Cleaning of the raw inputs (dedupe, validity, null fills, contactability)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.functions import constants as K
from shopsignal.functions.scalar import flag
from shopsignal.sources.schemas import opt_col

DATE = "SaleTransactionDate"
AMOUNT = "SalesNetAmountEuro"
QTY = "Quantity"


def quarantined(tx: DataFrame) -> DataFrame:
    """Rows whose sale date could not be parsed (kept aside, not silently dropped)."""
    return tx.filter(F.col(DATE).isNull())


def valid_transactions(tx: DataFrame) -> DataFrame:
    """amount >= 0 AND quantity > 0 (NULL fails) AND a parsed date."""
    return tx.filter((F.col(AMOUNT) >= 0) & (F.col(QTY) > 0) & F.col(DATE).isNotNull())


def dedup_transactions(tx: DataFrame) -> DataFrame:
    """Full-row dedupe (one hash-aggregate shuffle on all columns)."""
    return tx.dropDuplicates()


def clean_transactions(tx: DataFrame, dedupe: bool = True) -> DataFrame:
    """Validity filter first (row-wise, shrinks the shuffle), then full-row dedupe.

    Same result as dedupe-then-filter. ``dedupe=False`` skips the shuffle when the source
    guarantees unique rows.
    """
    t = valid_transactions(tx)
    return dedup_transactions(t) if dedupe else t


def clean_products(products: DataFrame) -> DataFrame:
    return products.fillna({"Category": K.UNKNOWN, "FamilyLevel1": K.UNKNOWN,
                            "FamilyLevel2": K.UNKNOWN, "Universe": K.UNISEX})


def clean_clients(clients: DataFrame) -> DataFrame:
    c = clients.drop("Age") if "Age" in clients.columns else clients
    c = c.fillna({"ClientGender": K.UNKNOWN, "ClientSegment": K.REGULAR})
    has_email = flag(opt_col(c, "ClientOptINEmail", None) == 1)
    has_phone = flag(opt_col(c, "ClientOptINPhone", None) == 1)
    return (c.withColumn("HasEmail", has_email).withColumn("HasPhone", has_phone)
             .withColumn("HasContact", ((F.col("HasEmail") == 1) | (F.col("HasPhone") == 1)).cast("int")))
