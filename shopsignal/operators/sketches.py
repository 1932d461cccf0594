"""Approximate quantiles by mergeable sketches (KLL): the ``approx`` form of the exact scans in ``numeric``.

A sketch holds a few kilobytes whatever the number of rows, is built before any shuffle and merges with others, so
stored sketches per country or day answer for any union of them. The exact forms stay the default.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 800      # the sketch's parameter k


def rank_error(k: int = SIZE) -> float:
    """Published error of a KLL sketch's rank of one quantile, as a share of n, at 99% confidence: 0.35% for 800."""
    return 2.296 / k ** 0.9723


def sketches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = SIZE) -> DataFrame:
    """One sketch a group and column: (keys, column names). NULLs are left out."""
    return df.groupBy(*keys).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in columns])


def merged(parts: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sketches of the unions of groups: what one pass over all their rows would give, within the same error."""
    return parts.groupBy(*keys).agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def quantiles(column: str, ps: Sequence[float]) -> Column:
    """The column of quantile arrays of a sketch column; NULL for a sketch without values."""
    c = F.col(column)
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.array(*[F.lit(float(p)) for p in ps])))


def approx_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], k: int = SIZE) -> dict[str, list[float | None]]:
    """As ``numeric.exact_quantiles``, in one aggregate: each result is a value of the column whose rank is off by ``rank_error(k)``
    of the rows at most (99% of the time); the least and greatest (0 and 1) are exact. No interpolation."""
    row = sketches(df, [], list(wanted), k).select(*[quantiles(c, ps).alias(c) for c, ps in wanted.items()]).first()
    return {c: (list(row[c]) if row and row[c] is not None else [None] * len(ps)) for c, ps in wanted.items()}


def measured_rank_errors(df: DataFrame, found: dict[str, dict[float, float]]) -> DataFrame:
    """(Column, P, Rows, RankError): how far each found value's rank lies from ``P``, as a share of the rows; one aggregate.

    A value that several rows share has all their ranks, and the nearest counts.
    """
    if not found:
        return df.sparkSession.createDataFrame([], "Column string, P double, Rows long, RankError double")
    out = None
    aggregates = []
    for i, (c, values) in enumerate(found.items()):
        x = F.col(c).cast("double")
        aggregates.append(F.count(x).alias(f"n{i}"))
        for j, v in enumerate(values.values()):
            aggregates += [F.count_if(x < F.lit(v)).alias(f"lt{i}_{j}"), F.count_if(x <= F.lit(v)).alias(f"le{i}_{j}")]
    row = df.agg(*aggregates)
    for i, (c, values) in enumerate(found.items()):
        n = F.col(f"n{i}").cast("double")
        for j, p in enumerate(values):
            error = F.greatest(F.lit(0.0), F.lit(float(p)) - F.col(f"le{i}_{j}") / n, F.col(f"lt{i}_{j}") / n - F.lit(float(p)))
            one = row.select(F.lit(c).alias("Column"), F.lit(float(p)).alias("P"), F.col(f"n{i}").alias("Rows"), error.alias("RankError"))
            out = one if out is None else out.unionByName(one)
    return out
