"""Hashed similar items against the exact lists: recall, coverage, exact values, copies and large buckets."""
import numpy as np
import pytest

from shopsignal.operators import sequences, similarity


def table(spark, vectors):
    return spark.createDataFrame([(f"p{i:05d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "ProductID string, embedding array<double>")


def rows(df):
    return {(r.ProductID, r.SimilarProductID): (round(r.similarity, 6), r.Rank) for r in df.collect()}


def clustered(n, clusters, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[rng.integers(0, clusters, n)] + 0.3 * rng.standard_normal((n, dim))


def test_clusters_are_found_in_few_pairs(spark):
    df = table(spark, clustered(6_000, 300, 16)).cache()
    plan = similarity.choose_plan(df.selectExpr("ProductID as id", "embedding as v"), 5)
    assert plan.bits >= 4 and plan.pairs < 6_000 / 3          # expected work well under all pairs
    exact, found = sequences.similar_products(df, 5), similarity.similar_by_hash(df, 5)
    want, got = rows(exact), rows(found)
    assert len(got) == len(want) == 30_000                    # every product has its five rows
    hits = set(want) & set(got)
    assert len(hits) / len(want) >= 0.9
    assert all(want[p][0] == got[p][0] for p in hits)         # similarities are exact
    quality = similarity.neighbour_recall(found, exact).first()
    assert quality.Products == quality.Covered == 6_000 and quality.Recall == pytest.approx(len(hits) / len(want))


def test_copies_zero_vectors_nulls_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BUCKET_BLOCK", 20)       # buckets of some hundreds are dealt to blocks
    base = list(clustered(150, 4, 8, seed=2))
    vectors = base + [base[0]] * 200 + [np.zeros(8)] * 3 + [None] * 4
    df = table(spark, vectors)
    want, got = rows(sequences.similar_products(df, 5)), rows(similarity.similar_by_hash(df, 5, min_bits=2))
    assert len(got) == len(want) == 353 * 5
    assert len(set(want) & set(got)) / len(want) >= 0.9
    for n in (0, 1, 2, 4):
        small = table(spark, base[:n])
        assert rows(similarity.similar_by_hash(small, 5)) == rows(sequences.similar_products(small, 5))


def test_scored_slices_do_not_change_the_exact_lists(monkeypatch):
    m, ids = sequences.unit_rows(clustered(300, 10, 8, seed=3)), np.array([f"p{i}" for i in range(300)])
    want = sequences.best_rows(ids, m, ids, m, 5)
    monkeypatch.setattr(sequences, "SCORE_BYTES", 5_000)      # two queries at once
    got = sequences.best_rows(ids, m, ids, m, 5)
    assert want[["_id", "_nid"]].equals(got[["_id", "_nid"]]) and np.allclose(want["_sim"], got["_sim"])
