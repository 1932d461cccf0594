"""Distributed ordered scans and exact quantile scoring.

``ordered_scan`` gives, for rows ordered within groups, the row number, the running sum and
the previous row's values *without* sending a group to one task: rows are range-partitioned
on (group keys, order keys) so a hot group is split over many partitions; each partition is
scanned locally and a per-partition summary (one row per partition) supplies the carry-in
for groups that continue from earlier partitions. The range-partitioned data is sorted, numbered and
checkpointed to the shared checkpoint folder, so partitions and places stay fixed if tasks are re-run; the
number stands for the order, whose columns need not be written.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.session import default_partitions, ensure_checkpoint_dir, shuffles_removed

_PID, _AT = "_scan_pid", "_scan_at"


def _order_col(o) -> Column:
    return F.col(o) if isinstance(o, str) else o


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence, *,
                 sum_col: str | Sequence[str] | None = None, lag_cols: Sequence[str] = (),
                 keep: Sequence[str] | None = None, num_partitions: int | None = None, prefix: str = "") -> DataFrame:
    """Append ``{prefix}rn`` (1-based), ``{prefix}cum`` (inclusive running sum of ``sum_col``; of
    several columns ``{prefix}cum_<c>`` each) and ``{prefix}prev_<c>`` for each lag column, within
    ``keys`` groups ordered by ``order``.

    ``order`` must make rows of a group totally ordered (add tie-break columns). Keys must not be
    NULL. The range-partitioned scan is the only path, whatever the size of a group. With ``keep`` only those columns of
    ``df`` are written and returned, besides the keys and the columns that are summed or lagged.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or default_partitions(spark)
    keys = list(keys)
    sums = {"cum": sum_col} if isinstance(sum_col, str) else {f"cum_{c}": c for c in sum_col or ()}
    order_cols = [_order_col(o) for o in order]
    written = df.columns if keep is None else [c for c in df.columns if c in {*keys, *lag_cols, *sums.values(), *keep}]
    by = [*[F.col(k) for k in keys], *order_cols]
    with shuffles_removed(spark):
        ranged = (df.repartitionByRange(n, *by).sortWithinPartitions(*by)
                    .select(*written, F.monotonically_increasing_id().alias(_PID))
                    .checkpoint(eager=True))
    # a row's number is that of its partition, 33 bits up, and its place there
    ranged = ranged.withColumn(_AT, F.col(_PID)).withColumn(_PID, F.shiftright(_PID, 33))

    w = Window.partitionBy(_PID, *keys).orderBy(_AT)
    wcum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_lrn", F.row_number().over(w))
    for name, c in sums.items():
        local = local.withColumn(f"_l{name}", F.sum(c).over(wcum))
    for lc in lag_cols:
        local = local.withColumn(f"_lprev_{lc}", F.lag(lc).over(w))

    # one row per partition: its first group key and its last row (key, counts, lag values)
    key_struct = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    sort_struct = F.struct(*[F.col(k) for k in keys], F.col("_lrn"))
    last_fields = [F.col("_lrn").alias("rn")]
    last_fields += [F.col(f"_l{name}").alias(name) for name in sums]
    last_fields += [F.col(lc).alias(f"v_{lc}") for lc in lag_cols]
    summary = local.groupBy(_PID).agg(
        F.min(key_struct).alias("_first_key"),
        F.max_by(F.struct(key_struct.alias("k"), *last_fields), sort_struct).alias("_last"),
    )
    if keys:        # its rows lie by partition: one task holds them from here, as the windows would at their end
        summary = summary.coalesce(1)
    # carry into partition p from earlier partitions whose last group is p's first group.
    # Earlier partitions ending in that key are contiguous, so a per-key running total over the
    # (tiny, one row per partition) summary table gives the carry.
    ws = Window.partitionBy(F.col("_last.k")).orderBy(_PID)
    summary = summary.withColumn("_krn", F.sum("_last.rn").over(ws))
    for name in sums:
        summary = summary.withColumn(f"_k{name}", F.sum(f"_last.{name}").over(ws))
    wp = Window.orderBy(_PID)
    prev_key = F.lag(F.col("_last.k")).over(wp)
    carry = summary.select(
        F.col(_PID),
        F.col("_first_key"),
        prev_key.alias("_prev_key"),
        F.lag("_krn").over(wp).alias("_c_rn"),
        *[F.lag(f"_k{name}").over(wp).alias(f"_c_{name}") for name in sums],
        *[F.lag(F.col(f"_last.v_{lc}")).over(wp).alias(f"_c_{lc}") for lc in lag_cols],
    )
    same = F.coalesce(F.col("_prev_key") == F.col("_first_key"), F.lit(False))
    carry = carry.select(
        _PID, F.col("_first_key").alias("_fk"),
        F.when(same, F.col("_c_rn")).otherwise(0).alias("_o_rn"),
        *[F.when(same, F.col(f"_c_{name}")).alias(f"_o_{name}") for name in sums],
        *[F.when(same, F.col(f"_c_{lc}")).alias(f"_o_{lc}") for lc in lag_cols],
    )
    # the carry table has one row per partition: a proven bound for broadcasting
    out = local.join(F.broadcast(carry), _PID, "left")
    in_first = (key_struct == F.col("_fk")) if keys else F.lit(True)
    out = out.withColumn(f"{prefix}rn", F.col("_lrn") + F.when(in_first, F.col("_o_rn")).otherwise(0))
    for name in sums:
        out = out.withColumn(f"{prefix}{name}", F.col(f"_l{name}") + F.when(in_first, F.coalesce(F.col(f"_o_{name}"), F.lit(0))).otherwise(0))
    for lc in lag_cols:
        carried = F.when(in_first & (F.col("_lrn") == 1), F.col(f"_o_{lc}"))
        out = out.withColumn(f"{prefix}prev_{lc}", F.coalesce(F.col(f"_lprev_{lc}"), carried))
    drop = [_PID, _AT, "_lrn", "_fk", "_o_rn"] + [f"{x}{name}" for name in sums for x in ("_l", "_o_")] \
        + [f"_lprev_{lc}" for lc in lag_cols] + [f"_o_{lc}" for lc in lag_cols]
    return out.drop(*drop)


def shared_folder(spark, label: str) -> str:
    """A fresh folder in the shared folder of driver and executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: cuts lineage, survives
    executors, and later reads prune columns. Shuffles on the way are gone with the write."""
    path = shared_folder(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 100_000   # the largest dimension that a join may send whole to every executor


def sized(dim: DataFrame) -> DataFrame:
    """``dim`` with a merge join asked for where it has more than BROADCAST_ROWS rows.

    The optimizer takes the size of a table's compressed files for its size in memory, and would send millions of rows of a few
    bytes each through the driver."""
    return dim.hint("merge") if dim.count() > BROADCAST_ROWS else dim


def average_rank_pct(df: DataFrame, value: str, out: str = "pct_rank") -> DataFrame:
    """pandas ``rank(pct=True)`` (average method): (#smaller + (ties+1)/2) / n.

    Works on the distinct (value, count) table, so a value held by many rows is one row; the
    distributed ordered scan gives its running counts.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    scanned = ordered_scan(counts, [], [F.col(value)], sum_col="_cnt", prefix="_v")
    ranks = scanned.select(
        value, ((F.col("_vcum") - F.col("_cnt")) + (F.col("_cnt") + 1) / F.lit(2.0)).alias("_avg_rank"))
    total = df.select(F.count(F.lit(1))).scalar().cast("double")
    return df.join(ranks, value, "left").withColumn(out, F.col("_avg_rank") / total).drop("_avg_rank")


def quintile_scores(df: DataFrame, spec: dict[str, tuple[str, bool]], quantiles=None) -> DataFrame:
    """1..5 scores of several columns: ``{value: (score column, ascending)}``.

    With distinct quintile edges (min, p20..p80, max, linear interpolation): 1 + #{p_k < x}. If
    any edge repeats, average-rank percentile bins (0, .2], (.2, .4], ... Descending scores are
    6 - score. All edges come from one quantile scan; the rank fallback runs only when needed.
    ``quantiles`` replaces the exact scan (``sketches.approx_quantiles``).
    """
    edges = (quantiles or exact_quantiles)(df, {value: [0.0, 0.2, 0.4, 0.6, 0.8, 1.0] for value in spec})
    for value, (out, ascending) in spec.items():
        own = edges[value]
        if None not in own and len(set(own)) == 6:
            x, bounds = F.col(value).cast("double"), own[1:5]
        else:
            df = average_rank_pct(df, value, out="_pr")
            x, bounds = F.col("_pr"), [0.2, 0.4, 0.6, 0.8]
        score = F.lit(1)
        for b in bounds:
            score = score + F.when(x > F.lit(b), 1).otherwise(0)
        df = df.withColumn(out, (score if ascending else 6 - score).cast("int")).drop("_pr")
    return df


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (pandas/NumPy default) of several columns at once.

    The columns are stacked as (column, value, count), so a hot value is one row; one keyed
    ordered scan gives the running counts, and the needed order statistics come back as one row.
    """
    names = list(wanted)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(names)])).alias("_s")).select("_s.*")
    counts = stacked.filter(F.col("_v").isNotNull()).groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    scanned = materialize(ordered_scan(counts, ["_i"], ["_v"], sum_col="_cnt", prefix="_q"), "quantiles")
    sizes = {r["_i"]: r["n"] for r in scanned.groupBy("_i").agg(F.sum("_cnt").alias("n")).collect()}   # a row per column
    before = F.col("_qcum") - F.col("_cnt")
    picks = {(i, r) for i, c in enumerate(names) if i in sizes for p in wanted[c] for r in _ranks(sizes[i], p)}
    row = scanned.agg(F.lit(0).alias("_none"), *[
        F.max(F.when((F.col("_i") == i) & (before <= r) & (F.col("_qcum") > r), F.col("_v"))).alias(f"v{i}_{r}") for i, r in sorted(picks)]).first()
    out = {}
    for i, c in enumerate(names):
        out[c] = [None] * len(wanted[c])
        for k, p in enumerate(wanted[c] if i in sizes else []):
            lo, hi = _ranks(sizes[i], p)
            a, b = row[f"v{i}_{lo}"], row[f"v{i}_{hi}"]
            out[c][k] = a + (b - a) * ((sizes[i] - 1) * p - lo)
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    lo = math.floor((n - 1) * p)
    return lo, min(lo + 1, n - 1)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, *, rank_col: str = "Rank") -> DataFrame:
    """Rows ranked 1..k per ``keys`` group under a total ``order``.

    Spark keeps only k rows of a group in each map task before the exchange, so a hot group
    sends at most k rows per task. Without keys, a distributed take precedes the ranking.
    """
    order_cols = [_order_col(o) for o in order]
    if not keys:
        df, w = df.orderBy(*order_cols).limit(k), Window.orderBy(*order_cols)      # k rows
    else:
        w = Window.partitionBy(*[F.col(c) for c in keys]).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, out: str) -> DataFrame:
    """Exact linear-interpolation quantile of ``value`` within each ``keys`` group (keys not NULL).

    Per-group value counts first; the ordered scan gives running counts per group (a group with
    many distinct values is split over tasks), and the two order statistics around (n-1)·p are
    picked per group and interpolated as NumPy does. No task holds a group's distinct values.
    """
    keys = list(keys)
    counts = (df.filter(F.col(value).isNotNull())
                .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_cnt")))
    scanned = materialize(ordered_scan(counts, keys, [F.col("_v")], sum_col="_cnt", prefix="_g"), "quantiles")
    return scanned_quantile(scanned, keys, "_v", "_cnt", "_gcum", p, out)


def scanned_quantile(scanned: DataFrame, keys: Sequence[str], value: str, count: str, running: str, p: float, out: str) -> DataFrame:
    """The quantile of each group from its distinct values with their counts and running counts (an ordered scan's)."""
    h = (F.col("_n") - 1) * F.lit(p)
    ranks = scanned.groupBy(*keys).agg(F.sum(count).alias("_n")).select(
        *keys, h.alias("_h"), F.floor(h).cast("bigint").alias("_lo"),
        F.least(F.floor(h).cast("bigint") + 1, F.col("_n") - 1).alias("_hi"))
    j = scanned.join(ranks, keys)
    v, before = F.col(value).cast("double"), F.col(running) - F.col(count)
    picked = j.groupBy(*keys).agg(
        F.max(F.when((before <= F.col("_lo")) & (F.col(running) > F.col("_lo")), v)).alias("_a"),
        F.max(F.when((before <= F.col("_hi")) & (F.col(running) > F.col("_hi")), v)).alias("_b"),
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"))
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo"))).alias(out))
