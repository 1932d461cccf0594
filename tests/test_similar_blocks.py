"""Hashed similar items by pairs of blocks against buckets of each table; all-pairs lists with one copy per block."""
import numpy as np
from pyspark.sql import functions as F

from shopsignal.operators import sequences, similarity
from test_similarity import clustered, rows, table


def copies(found) -> dict[tuple, list[tuple]]:
    """The rows of each pair of blocks: id and own block."""
    groups = {}
    for r in found.collect():
        groups.setdefault((r["_i"], r["_j"]), []).append((r["_id"], r["_own"]))
    return groups


def test_every_pair_meets_once_with_a_copy_per_block(spark):
    df = spark.range(40).select(F.format_string("p%02d", "id").alias("_id"), F.array(F.lit(1.0)).alias("_v"))
    dealt = sequences.pair_blocks(df, 4)
    assert dealt.count() == 160                          # four copies, eight before
    met = set()
    for (i, j), members in copies(dealt).items():
        pairs = {(a, b) for a, x in members for b, y in members if a < b and (i == j or x != y)}
        assert not met & pairs
        met |= pairs
    assert len(met) == 40 * 39 // 2


def test_blocks_find_the_buckets_of_all_tables(monkeypatch):
    """Against the definition: candidates that share a key in a table, the best by rounded similarity, then id."""
    m = sequences.unit_rows(np.vstack([clustered(120, 6, 8, seed=4), np.zeros((2, 8))]))
    ids = np.array([f"p{(7 * i) % 122:03d}" for i in range(122)])
    planes, tables, bits, k = np.random.default_rng(3).standard_normal((8, 5 * 3)), 5, 3, 4
    keys = similarity.bucket_keys(m, planes, tables, bits)
    sims = np.round(m @ m.T, 6)
    for q, c in ((range(122), range(122)), (range(50), range(50, 122))):
        want = {}
        for a in q:
            near = sorted((-sims[a, b], ids[b]) for b in c if ids[a] != ids[b] and (keys[a] == keys[b]).any())[:k]
            want |= {(ids[a], n): -s for s, n in near}
        q, c = list(q), list(c)
        for most in (32 << 20, 500):
            monkeypatch.setattr(similarity, "SCORE_BYTES", most)
            got = similarity.bucket_pairs(ids[q], m[q], ids[c], m[c], planes, tables, bits, k)
            assert {(a, b): round(s, 6) + 0.0 for a, b, s in got.itertuples(index=False)} == {p: s + 0.0 for p, s in want.items()}


def test_the_same_lists_by_blocks_and_by_tables(spark, monkeypatch):
    df = table(spark, list(clustered(400, 8, 8, seed=5)) + [np.ones(8)] * 9 + [None]).cache()
    by_blocks = rows(similarity.similar_by_hash(df, 5, min_bits=3))
    asked, real = [], similarity._met_by_table
    monkeypatch.setattr(similarity, "_met_by_table", lambda *a: asked.append(1) or real(*a))
    assert rows(similarity.similar_by_hash(df, 5, min_bits=3)) == by_blocks and not asked
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 1)     # more blocks than tables
    assert rows(similarity.similar_by_hash(df, 5, min_bits=3)) == by_blocks and asked


def test_recall_writes_both_lists_once(spark, monkeypatch):
    df = table(spark, clustered(60, 4, 8, seed=6)).cache()
    lists = sequences.similar_products(df, 3)
    seen, real = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, label: seen.append(label) or real(df, label))
    quality = similarity.neighbour_recall(lists.filter("Rank < 3 or ProductID < 'p00030'"), lists)
    assert seen == ["neighbours"] * 2
    assert tuple(quality.first()) == (60, 30, 150 / 180)
    assert "FlatMapGroupsInPandas" not in quality._jdf.queryExecution().executedPlan().toString()
