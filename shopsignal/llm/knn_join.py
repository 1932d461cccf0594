"""Exact top-k search by a Voronoi kNN join.

The largest inner products are nearest neighbours once every data vector gets one more component,
sqrt(M**2 - |v|**2) with M the largest norm, and every query a zero there. Queries and data are
grouped by their nearest pivot; the number of pivots grows with the table. The rows next to each pivot
(the summary of its cell, bounded by bytes) give every query an upper bound of its k-th distance. A cell of queries
keeps the greatest of these bounds and, for every pivot, the range of its queries' distances, and of their places on
the line between its own pivot and that one. A row is copied to a cell of queries only if neither the triangle inequality
nor those lines (the hyperplanes between cells, moved) put it out of reach. Cells that need more than ``wide`` of
all rows are joined into one, to which each row is sent once. Groups split into blocks of
bounded size, are solved locally, and the blocks' best are merged.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.llm.common import materialize

SATURATED = 2 ** 63 - 1
MOST_PIVOTS = 256
SUMMARY_BYTES = 8 << 20         # of the cells' summaries, on the driver and in every task


def integer_components(embedding: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of every component; None if null or if a component is null or not finite."""
    if embedding is None or any(x is None for x in embedding):
        return None
    x = np.array(embedding, np.float64)
    if not np.isfinite(x).all():
        return None
    y = np.floor(scale * x)
    if (np.abs(y) < 2.0 ** 62).all():
        return y.astype(np.int64)
    return np.array([min(max(int(c), -SATURATED), SATURATED) if math.isfinite(c) else int(math.copysign(SATURATED, c)) for c in y], np.int64)


def _vectors(batches, scale):
    for batch in batches:
        ids, lists, asks = (c.to_pylist() for c in batch.columns)
        rows = [(i, v, q) for i, e, q in zip(ids, lists, asks) if i is not None and (v := integer_components(e, scale)) is not None]
        yield pa.RecordBatch.from_pydict({
            "vec_id": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1].tobytes() for r in rows], pa.binary()),
            "is_query": pa.array([bool(r[2]) for r in rows], pa.bool_()),
            "norm": pa.array([float((r[1].astype(np.float64) ** 2).sum()) for r in rows], pa.float64())})


def _integers(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), -1) if len(blobs) else np.zeros((0, 0), np.int64)


def _distances(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * m @ p.T, 0))


class Space:
    """Pivots of the vectors of one length, in the space with the added component."""

    def __init__(self, rows: list, largest: float):
        self.pivots = self.lifted([bytes(r.v) for r in rows], np.array([r.norm for r in rows]), largest)
        self.between = _distances(self.pivots, self.pivots)
        # rounding can move a distance by about this much
        self.slack = 1e-6 * math.sqrt(largest * max(1, self.pivots.shape[1] / 64)) + 1e-6

    @staticmethod
    def lifted(blobs: list, norms: np.ndarray, largest: float, query: bool = False) -> np.ndarray:
        m = _integers(blobs).astype(np.float64)
        return np.column_stack([m, np.zeros(len(m)) if query else np.sqrt(np.maximum(largest - norms, 0))])

    def places(self, d: np.ndarray, cell: int) -> np.ndarray:
        """Where points with distances ``d`` to the pivots lie on the lines from a cell's pivot to the others."""
        gap = np.where(self.between[cell] > self.slack, 2 * self.between[cell], np.inf)
        return (d[:, [cell]] ** 2 - d ** 2) / gap


def _assign(batches, spaces: dict[int, Space], largest: float):
    """The nearest pivot of every row and its distance; and the nearest of every query, which has nothing in the added component."""
    for batch in batches:
        rows = batch.to_pandas()
        for size, part in rows.groupby(rows["v"].str.len()):
            blobs, out = part["v"].tolist(), {}
            for role, query in (("", False), ("q_", True)):
                d = _distances(Space.lifted(blobs, part["norm"].to_numpy(), largest, query), spaces[size].pivots)
                out[role + "cell"], out[role + "dist"] = d.argmin(1).astype(np.int32), d.min(1)
            frame = part[["vec_id", "v", "is_query", "norm"]].assign(size=np.int32(size), cell=out["cell"], dist=out["dist"], q_cell=out["q_cell"])
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False, schema=pa.schema([
                ("vec_id", pa.int64()), ("v", pa.binary()), ("is_query", pa.bool_()), ("norm", pa.float64()), ("size", pa.int32()),
                ("cell", pa.int32()), ("dist", pa.float64()), ("q_cell", pa.int32())]))


def _reaches(batches, spaces, near, largest, k):
    """Per cell of queries in a batch: the greatest bound of a k-th distance, and the ranges of distances to and places between pivots."""
    for batch in batches:
        rows = batch.to_pandas()
        for (size, cell), part in rows.groupby(["size", "q_cell"]):
            space, (ids, summary) = spaces[size], near[size]
            found = []
            for a in range(0, len(part), 256):
                own = part.iloc[a:a + 256]
                m = Space.lifted(own["v"].tolist(), None, largest, query=True)
                d = _distances(m, summary)
                d[own["vec_id"].to_numpy()[:, None] == ids] = np.inf            # an id's own rows are no neighbours
                # rows of one id count once each: equal ids stand together, keep the nearest
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                d = np.minimum.reduceat(d, starts, axis=1)
                theta = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(m), np.inf)
                to = _distances(m, space.pivots)
                line = space.places(to, cell)
                found.append((theta.max(), to.min(0), to.max(0), line.min(0), line.max(0)))
            yield pa.RecordBatch.from_pydict({
                "size": pa.array([size], pa.int32()), "cell": pa.array([cell], pa.int32()), "n": pa.array([len(part)], pa.int64()),
                "theta": pa.array([float(max(f[0] for f in found))]),
                **{name: pa.array([fold([f[i] for f in found]).tolist()]) for name, i, fold in (
                    ("near", 1, lambda x: np.min(x, 0)), ("far", 2, lambda x: np.max(x, 0)), ("low", 3, lambda x: np.min(x, 0)), ("high", 4, lambda x: np.max(x, 0)))}})


def _needed(space: Space, d: np.ndarray, asked: dict) -> np.ndarray:
    """Which rows, by their distances to the pivots, a cell of queries may need."""
    if not math.isfinite(asked["theta"]):
        return np.ones(len(d), bool)
    reach = asked["theta"] + space.slack
    ok = (d - asked["far"]).max(1) <= reach
    ok &= (asked["near"] - d).max(1) <= reach
    at = np.flatnonzero(ok)
    line = space.places(d[at], asked["cell"])
    ok[at] = np.maximum(line - asked["high"], asked["low"] - line).max(1) <= reach
    return ok


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of each query's k highest inner products, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    size = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    exact = size(queries) * size(data) * max(1, data.shape[1]) < 2 ** 53
    # beyond exact doubles: Python integers
    queries, data = (m.astype(np.float64) if exact else m.astype(object) for m in (queries, data))
    out = []
    for a in range(0, len(queries), 64):
        scores = queries[a:a + 64] @ data.T
        for q, row in zip(query_ids[a:a + 64], scores):
            other = np.flatnonzero(ids != q)
            if not len(other):
                continue
            own = row[other]
            if len(own) > k and own.dtype != object:
                least = np.partition(own, len(own) - k)[len(own) - k]
                above, level = np.flatnonzero(own > least), np.flatnonzero(own == least)
                pick = np.concatenate([above, level[:k - len(above)]])   # ids ascend: the smallest of the tied
            else:
                pick = np.arange(len(own))
            pick = pick[np.lexsort((ids[other][pick], -own[pick].astype(np.float64)))] if own.dtype != object else \
                np.array(sorted(pick.tolist(), key=lambda i: (-own[i], ids[other][i])))
            out += [(int(q), int(ids[other[i]]), min(max(int(own[i]), -2 ** 63), 2 ** 63 - 1)) for i in pick[:k]]
    return out


def top_inner_products(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
                       scale: float = 256.0, pivots: int | None = None, block: int = 20_000, query_block: int = 2_000, wide: float = 0.5,
                       report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row chosen by ``is_query`` its k highest scores.

    Components are floor(scale * x), saturated at 64 bits; the score is the integer inner product
    with every other row of the same length; ties go to the smaller vec_id. Rows with a null
    vec_id, a null vector, or a null or non-finite component take no part; rows that repeat count
    once, and a query never meets rows of its own vec_id; fewer than k others give fewer rows; an
    empty table gives no rows; other columns are not read. ``pivots`` rows, the first by hash, are
    the pivots (a bounded sample; they change speed, not results): a quarter of the square root of the
    number of rows, at least 16 and at most MOST_PIVOTS, if not given. ``report`` is filled with the numbers of rows,
    of query cells, and of copies (rows that groups of queries get).
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    vecs = materialize(base.mapInArrow(lambda b: _vectors(b, scale), "vec_id long, v binary, is_query boolean, norm double")
                       .dropDuplicates(["vec_id", "v"]), "vectors")
    result = "query_id long, rank int, vec_id long, score long"
    sizes = {r.size: r.n for r in vecs.groupBy(F.octet_length("v").alias("size")).agg(F.count("*").alias("n")).collect()}   # a row per length of a vector
    if not sizes:
        return spark.createDataFrame([], result)
    largest = vecs.agg(F.max("norm")).first()[0]
    spaces = {}
    for size, n in sizes.items():
        most = pivots or min(MOST_PIVOTS, max(16, math.isqrt(n) // 4))
        spaces[size] = Space(vecs.filter(F.octet_length("v") == size).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v", "norm").collect(), largest)
    cells = materialize(vecs.mapInArrow(lambda b: _assign(b, spaces, largest),
                                        "vec_id long, v binary, is_query boolean, norm double, size int, cell int, dist double, q_cell int"), "cells")
    # summaries: the rows next to each pivot; k of different ids are somewhere among them, if there are so many
    nearest = Window.partitionBy("size", "cell").orderBy("dist", "vec_id", "v")
    near = {}
    for size in sizes:
        each = max(k + 1, min(64, SUMMARY_BYTES // (2 * max(size, 8) * len(spaces[size].pivots))))
        own = cells.filter(F.col("size") == size).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= each).select("vec_id", "v", "norm").collect()
        own.sort(key=lambda r: r.vec_id)
        near[size] = np.array([r.vec_id for r in own]), Space.lifted([bytes(r.v) for r in own], np.array([r.norm for r in own]), largest)
    parts = cells.filter("is_query").mapInArrow(lambda b: _reaches(b, spaces, near, largest, k),
                                                "size int, cell int, n long, theta double, near array<double>, far array<double>, low array<double>, high array<double>")
    at = F.posexplode(F.arrays_zip("near", "far", "low", "high"))
    folded = materialize(parts, "reaches")
    totals = folded.groupBy("size", "cell").agg(F.sum("n").alias("n"), F.max("theta").alias("theta")).collect()              # a row per cell
    ranges = folded.select("size", "cell", at.alias("p", "x")).groupBy("size", "cell", "p").agg(
        F.min("x.near").alias("near"), F.max("x.far").alias("far"), F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    asked = {(r.size, r.cell): {"size": r.size, "cell": r.cell, "n": r.n, "theta": r.theta} | {c: np.zeros(len(spaces[r.size].pivots)) for c in ("near", "far", "low", "high")} for r in totals}
    if not asked:
        return spark.createDataFrame([], result)
    for r in ranges.collect():                                                                                              # pivots of each cell
        for c in ("near", "far", "low", "high"):
            asked[r.size, r.cell][c][r.p] = r[c]

    def by_size(rows: pd.DataFrame):
        """Rows of each vector length with their distances to its pivots."""
        for size, part in rows.groupby("size"):
            if any(s == size for s, _ in asked):
                yield size, part, _distances(Space.lifted(part["v"].tolist(), part["norm"].to_numpy(), largest), spaces[size].pivots)

    def counted(batches):
        total: dict = {}
        for batch in batches:
            for size, _, d in by_size(batch.to_pandas()):
                for key, a in asked.items():
                    if key[0] == size:
                        total[key] = total.get(key, 0) + int(_needed(spaces[size], d, a).sum())
        yield pa.RecordBatch.from_pydict({"size": pa.array([s for s, _ in total], pa.int32()), "cell": pa.array([c for _, c in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    need = {(r.size, r.cell): r.n for r in cells.mapInArrow(counted, "size int, cell int, n long").groupBy("size", "cell").agg(F.sum("n").alias("n")).collect()}
    # groups: a narrow cell alone; all wide ones of a length together, with every row
    plan = []
    for size, n in sizes.items():
        own = {key: a for key, a in asked.items() if key[0] == size}
        broad = [key for key in own if need[key] > wide * n]
        plan += [{"size": size, "cells": [key[1]], "all": False, "q": own[key]["n"], "rows": need[key]} for key in own if key not in broad]
        if broad:
            plan.append({"size": size, "cells": [c for _, c in broad], "all": True, "q": sum(own[key]["n"] for key in broad), "rows": n})
    for g in plan:
        g["q_blocks"], g["blocks"] = -(-g["q"] // query_block), max(1, -(-g["rows"] // block))
    if report is not None:
        report |= {"rows": sum(sizes.values()), "cells": len(asked), "wide": sum(len(g["cells"]) for g in plan if g["all"]),
                   "copies": sum(g["rows"] * g["q_blocks"] for g in plan), "queries": sum(g["q"] * g["blocks"] for g in plan)}

    def copies(batches):
        """Rows for every block of queries that can need them, and queries for every block of data."""
        for batch in batches:
            rows = batch.to_pandas()
            for size, part, d in by_size(rows):
                spread = pd.util.hash_array(part["vec_id"].to_numpy())
                for group, g in enumerate(plan):
                    if g["size"] != size:
                        continue
                    at = np.arange(len(part)) if g["all"] else np.flatnonzero(_needed(spaces[size], d, asked[size, g["cells"][0]]))
                    ask = np.flatnonzero(part["is_query"].to_numpy() & part["q_cell"].isin(g["cells"]).to_numpy())
                    for some, mine, others, role in ((at, g["blocks"], g["q_blocks"], False), (ask, g["q_blocks"], g["blocks"], True)):
                        for o in range(others if len(some) else 0):
                            b = (spread[some] % np.uint64(mine)).astype(np.int64)
                            place = (b * others + o) if role else (o * mine + b)     # query block * blocks + block
                            yield pa.RecordBatch.from_pydict({
                                "cell": pa.array(np.full(len(some), group, np.int32)), "part": pa.array(place.astype(np.int64)),
                                "vec_id": pa.array(part["vec_id"].to_numpy()[some]), "v": pa.array(part["v"].iloc[some].tolist(), pa.binary()),
                                "asks": pa.array(np.full(len(some), role))})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        q, s = rows[asks], rows[~asks]
        found = best(q["vec_id"].to_numpy(), _integers(q["v"].tolist()), s["vec_id"].to_numpy(), _integers(s["v"].tolist()), k) if len(q) and len(s) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    local = cells.mapInArrow(copies, "cell int, part long, vec_id long, v binary, asks boolean") \
        .groupBy("cell", "part").applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
