"""Quarantine of raw sales: one pass splits them, counts them by reason and keeps the rejected rows."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shopsignal.operators.cleaning import AMOUNT, DATE, QTY

#: in this order; the first that holds is a row's reason
REASONS = ("unparseable date", "missing date", "missing amount", "negative amount", "missing quantity", "quantity not positive")


def reason(date_text: str | None = None) -> Column:
    """Why a raw sale (with a parsed date) cannot count, NULL if it can. ``date_text`` names the column of the date's text, where there is one."""
    given = F.col(date_text).isNotNull() if date_text else F.lit(False)
    tests = (F.col(DATE).isNull() & given, F.col(DATE).isNull(), F.col(AMOUNT).isNull(), F.col(AMOUNT) < 0, F.col(QTY).isNull(), F.col(QTY) <= 0)
    out = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests))):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


@dataclass
class Split:
    clean: DataFrame          # the rows that can count (duplicates are still there)
    rejected: DataFrame       # the others, with Reason
    counts: dict[str, int]    # rows by reason, and "accepted"


def split(tx: DataFrame, folder: str, date_text: str | None = None) -> Split:
    """Write ``tx`` to ``folder`` once, in a part for each of accepted and rejected rows, counting on the way.

    The counters ride on the write (``DataFrame.observe``), so nothing is read twice; each side reads back only
    its own part (partition pruning).
    """
    seen = Observation("quarantine")
    tagged = tx.withColumn("Reason", reason(date_text)).withColumn("Rejected", F.col("Reason").isNotNull())
    counters = [F.count_if(F.col("Reason") == r).alias(r) for r in REASONS]
    tagged.observe(seen, F.count_if(~F.col("Rejected")).alias("accepted"), *counters).write.mode("overwrite").partitionBy("Rejected").parquet(folder)
    back = tx.sparkSession.read.schema(tagged.schema).parquet(folder)
    return Split(back.filter(~F.col("Rejected")).drop("Reason", "Rejected"), back.filter("Rejected").drop("Rejected"), dict(seen.get))
