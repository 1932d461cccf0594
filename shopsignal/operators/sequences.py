"""Purchase sequences: Markov transitions, ordered client histories, item embeddings and
exact cosine top-k."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignal.operators import skipgram
from shopsignal.operators.features import DATE, row_tiebreak
from shopsignal.operators.numeric import materialize, ordered_scan, top_k
from shopsignal.session import default_partitions

PART_SALES = 1_000_000  # sales of a part of the clients' histories, scanned and counted after the others
MOST_PARTS = 8
SENTENCE_CHUNK = 1000   # items of a sentence at most, as in Word2Vec (maxSentenceLength)


GLOBAL = "Global"


def markov_transitions(master: DataFrame, state_col: str = "FamilyLevel2", by: str | None = "StoreCountry") -> DataFrame:
    """Counts and probabilities of consecutive states per (country, client) history ordered
    by date; self-loops are skipped; prob = n / Σ n over (country, state). Without ``by``, the
    matrix of whole histories, under the country name GLOBAL.

    Whole histories are dealt to parts by hash, and many sales to more parts: one part's shuffles are gone, and its counts
    written, before the next is scanned."""
    if by is None:
        master, by = master.withColumn("_all", F.lit(GLOBAL)), "_all"
    tb = [c for c in row_tiebreak(master) if c not in ("ClientID", DATE)]
    src = master.filter(F.col(by).isNotNull() & F.col("ClientID").isNotNull()).select(by, "ClientID", DATE, *dict.fromkeys([state_col, *tb]))
    src = materialize(src, "states")          # the joins' shuffles are gone before the scan's
    parts = min(MOST_PARTS, max(1, -(-src.count() // PART_SALES)))
    part = F.pmod(F.xxhash64(by, "ClientID"), F.lit(parts))

    def counted(sales: DataFrame) -> DataFrame:
        scanned = ordered_scan(sales, [by, "ClientID"], [DATE, *tb], lag_cols=[state_col], keep=[], prefix="_m")
        prev = F.col(f"_mprev_{state_col}")
        return (scanned.filter(prev.isNotNull() & (prev != F.col(state_col)))
                       .groupBy(F.col(by).alias("Country"), prev.alias("State"), F.col(state_col).alias("NextState"))
                       .agg(F.count(F.lit(1)).alias("n")))

    if parts == 1:
        trans = counted(src)
    else:
        counts = [materialize(counted(src.filter(part == i)), "transitions") for i in range(parts)]
        trans = reduce(DataFrame.unionByName, counts).groupBy("Country", "State", "NextState").agg(F.sum("n").alias("n"))
    totals = trans.groupBy("Country", "State").agg(F.sum("n").alias("_tot"))
    return trans.join(totals, ["Country", "State"]).withColumn("prob", F.col("n") / F.col("_tot").cast("double")).drop("_tot")


def markov_topk(trans: DataFrame, k: int = 3) -> DataFrame:
    return top_k(trans, ["Country", "State"], [F.round("prob", 6).desc(), F.col("NextState")], k)


def client_sequences(master: DataFrame, item_col: str = "ProductID") -> DataFrame:
    """Each client's items in purchase order as rows (ClientID, Position, item): positions come
    from the skew-safe ordered scan, so a huge history is numbered by many tasks."""
    tb = [c for c in row_tiebreak(master) if c not in ("ClientID", DATE)]
    src = master.filter(F.col("ClientID").isNotNull() & F.col(item_col).isNotNull()).select("ClientID", DATE, *dict.fromkeys([item_col, *tb]))
    scanned = ordered_scan(src, ["ClientID"], [DATE, *tb], keep=[item_col], prefix="_s")
    return scanned.select("ClientID", F.col("_srn").cast("bigint").alias("Position"), F.col(item_col).cast("string").alias(item_col))


def word_counts(sequences: DataFrame, item_col: str = "ProductID", min_count: int = 2) -> DataFrame:
    return sequences.groupBy(item_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count)


def vocabulary(sequences: DataFrame, item_col: str = "ProductID", min_count: int = 2) -> DataFrame:
    """The items that training keeps: those with at least ``min_count`` occurrences."""
    return word_counts(sequences, item_col, min_count).select(item_col)


def sentences(sequences: DataFrame, item_col: str = "ProductID") -> DataFrame:
    """Rows of at most SENTENCE_CHUNK consecutive items of a client."""
    chunk = F.floor((F.col("Position") - 1) / SENTENCE_CHUNK).cast("int")
    grouped = sequences.groupBy("ClientID", chunk.alias("Chunk")).agg(
        F.array_sort(F.collect_list(F.struct("Position", F.col(item_col).alias("i")))).alias("_l"))
    return grouped.select("ClientID", "Chunk", F.transform("_l", lambda x: x["i"]).alias("items"))


def train_prod2vec(sequences: DataFrame, vector_size: int = 32, window: int = 3, min_count: int = 2,
                   epochs: int = 10, seed: int = 42) -> DataFrame:
    """(ProductID, embedding) of the vocabulary by skip-gram over the client sequences (``skipgram``: vectors lie in blocks that
    meet in tasks, never whole on the driver)."""
    return skipgram.item_vectors(sequences, word_counts(sequences, min_count=min_count), sentences, "ProductID", vector_size, window, epochs, seed)


def embedding_lookup(products: DataFrame, emb: DataFrame, dim: int = 32) -> DataFrame:
    """Every catalog product with its vector, zeros when the product is not in the vocabulary."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return (products.select("ProductID").join(emb, "ProductID", "left")
                    .withColumn("known", F.col("embedding").isNotNull().cast("int"))
                    .withColumn("embedding", F.coalesce(F.col("embedding"), zeros)))


BLOCK_VECTORS = 20_000   # at most so many vectors on either side of a group
SMALL_BLOCK = 256        # blocks are not split below this


def _blocks(n: int, spark) -> int:
    """Blocks of one side: of at most BLOCK_VECTORS, and enough for all tasks to have a pair."""
    return max(1, -(-n // BLOCK_VECTORS), min(-(-n // SMALL_BLOCK), math.isqrt(default_partitions(spark)) + 1))


SCORE_BYTES = 32 << 20   # of similarities that a task holds at once, besides their rounded copy and their order


def unit_rows(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def best_rows(qid: np.ndarray, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray, k: int) -> pd.DataFrame:
    """(_id, _nid, _sim): the k best candidates of each query but itself, by rounded similarity, then id.

    Queries are taken in slices, so that no more than SCORE_BYTES of similarities are held at once.
    """
    frames = []
    step = max(1, SCORE_BYTES // (8 * len(cm)))
    for s in range(0, len(qm), step):
        sims = qm[s:s + step] @ cm.T
        ids = qid[s:s + step]
        sims[ids[:, None] == cid[None, :]] = -np.inf
        kk = min(k, sims.shape[1])
        rounded = np.round(sims, 6)
        level = np.partition(rounded, sims.shape[1] - kk, axis=1)[:, sims.shape[1] - kk]
        row, col = np.nonzero((rounded >= level[:, None]) & np.isfinite(sims))     # ties at the k-th kept
        order = np.lexsort((cid[col], -rounded[row, col], row))
        row, col = row[order], col[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[nth < kk], col[nth < kk]
        frames.append(pd.DataFrame({"_id": ids[row], "_nid": cid[col], "_sim": sims[row, col]}))
    return pd.concat(frames, ignore_index=True)


def pair_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``vectors`` (_id and others) dealt to ``blocks`` blocks by a hash of _id, a copy for each pair of blocks (_i, _j),
    _i <= _j, that its own block (_own) is of: one row meets all others with ``blocks`` copies in all."""
    own = vectors.withColumn("_own", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with")).drop("_with")


def both_ways(pdf: pd.DataFrame, best) -> pd.DataFrame:
    """What ``best(query ids, query rows, candidate ids, candidate rows)`` finds in a pair of blocks, each asking the other; a block alone asks itself."""
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    sides = []
    for b in dict.fromkeys((i, j)):
        side = pdf[pdf["_own"] == b]
        if len(side):
            sides.append((side["_id"].to_numpy(str), unit_rows(np.vstack(side["_v"].to_numpy()))))
    asked = [(s, s) for s in sides] if i == j else [(a, b) for a in sides for b in sides if a is not b]
    found = [best(*q, *c) for q, c in asked]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"_id": pd.Series(dtype=str), "_nid": pd.Series(dtype=str), "_sim": pd.Series(dtype=float)})


def cosine_topk(candidates: DataFrame, id_col: str, vec_col: str, k: int = 5, blocks: int | None = None,
                queries: DataFrame | None = None, query_blocks: int | None = None) -> DataFrame:
    """Exact top-k cosine neighbours (excluding self) of every query vector among the
    candidates (queries default to the candidates themselves). NULL vectors take no part.

    2-D blocking: queries go to ``query_blocks`` blocks and candidates to ``blocks``; each pair of
    blocks is scored with NumPy inside one task, which keeps the k best per query by the declared
    order (similarity rounded to 6 places, then id), so the result is the same for any number of
    blocks; a second top-k merges the per-block winners. Where all ask all, two blocks meet once and ask each other, so a
    vector is copied once per block, not twice.
    """
    spark = candidates.sparkSession

    def prep(df):
        return df.select(F.col(id_col).cast("string").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v")).filter("_id is not null and _v is not null")
    cand = prep(candidates)
    qry = prep(queries) if queries is not None else cand
    blocks = blocks or _blocks(cand.count(), spark)
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_nid", T.StringType()),
                           T.StructField("_sim", T.DoubleType())])
    if queries is None and query_blocks in (None, blocks):
        partial = pair_blocks(cand, blocks).groupBy("_i", "_j").applyInPandas(
            lambda pdf: both_ways(pdf, lambda qid, qm, cid, cm: best_rows(qid, qm, cid, cm, k)), schema)
        return _ranked(partial, id_col, k)
    query_blocks = query_blocks or (_blocks(qry.count(), spark) if queries is not None else blocks)

    def own(n):
        return F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = qry.withColumn("qb", own(query_blocks)).withColumn("cb", each(blocks)).withColumn("role", F.lit(0))
    c = cand.withColumn("cb", own(blocks)).withColumn("qb", each(query_blocks)).withColumn("role", F.lit(1))
    both = q.unionByName(c)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, cs = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if qs.empty or cs.empty:
            return pd.DataFrame({"_id": pd.Series(dtype=str), "_nid": pd.Series(dtype=str), "_sim": pd.Series(dtype=float)})
        return best_rows(qs["_id"].to_numpy(str), unit_rows(np.vstack(qs["_v"].to_numpy())), cs["_id"].to_numpy(str), unit_rows(np.vstack(cs["_v"].to_numpy())), k)

    return _ranked(both.groupBy("qb", "cb").applyInPandas(score, schema), id_col, k)


def _ranked(partial: DataFrame, id_col: str, k: int) -> DataFrame:
    ranked = top_k(partial, ["_id"], [F.round("_sim", 6).desc(), F.col("_nid")], k)
    return ranked.select(F.col("_id").alias(id_col), F.col("_nid").alias(f"neighbor_{id_col}"),
                         F.col("_sim").alias("similarity"), "Rank")


def similar_products(emb: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """Top-k cosine neighbours of every vocabulary product (or of the ``queries`` products)."""
    q = None if queries is None else emb.join(queries.select("ProductID").distinct(), "ProductID", "left_semi")
    r = cosine_topk(emb, "ProductID", "embedding", k, queries=q)
    return r.select("ProductID", F.col("neighbor_ProductID").alias("SimilarProductID"), "similarity", "Rank")
