"""Item vectors: pairs, gradients, and training in blocks that never meet on the driver."""
import numpy as np
import pytest

from shopsignal.operators import sequences, skipgram


def test_pairs_of_all_blocks_are_those_of_the_window(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "SLICE_ITEMS", 4)
    lists = [[0, 1, 2, 1, 0, 3], [3], [2, 2], [], [4, 0, 4]]        # word w: block w % 2, number w // 2
    df = spark.createDataFrame([([(w % 2 << 32) | w // 2 for w in x],) for x in lists], "items array<long>").repartition(2)
    got = []
    for r in skipgram.packed_pairs(df, 2, 3).collect():
        out_block = (r.place + r.round) % 2
        for p in np.frombuffer(r.data, np.int64):
            got.append((int(p >> 34) * 2 + r.place, int(p >> 4 & (1 << 30) - 1) * 2 + out_block, int(p & 15)))
    assert sorted(got) == sorted((x[i], x[j], abs(i - j)) for x in lists for i in range(len(x)) for j in range(len(x)) if 0 < abs(i - j) <= 3)


@pytest.mark.parametrize("words", [3, 400])
def test_gradients_of_a_repeated_word_are_added_up_to_a_limit(words):
    rng = np.random.default_rng(1)
    idx, delta = rng.integers(0, words, 1_000), rng.random((1_000, 4)).astype(np.float32)
    m, want = np.zeros((words, 4), np.float32), np.zeros((words, 4), np.float32)
    skipgram.add_rows(m, idx, delta)
    np.add.at(want, idx, delta)
    times = np.bincount(idx, minlength=words)
    assert np.allclose(m, want * np.minimum(1, skipgram.STEP_REPEATS / np.maximum(1, times))[:, None], atol=1e-4)


def test_blocks_grow_with_words_and_pairs():
    assert skipgram.word_blocks(2, 10, 3) == 1 and skipgram.word_blocks(20_000, 600_000, 3) == 8
    assert skipgram.word_blocks(1_200_000, 36_000_000, 3) == 12 and skipgram.word_blocks(60_000_000, 10, 3) == 120
    assert skipgram.word_blocks(100_000, 600_000_000, 3) == 30


def test_items_bought_together_get_near_vectors_in_any_number_of_blocks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec
    def whole_on_the_driver(*_):
        raise AssertionError("the vocabulary's vectors were held by the driver")
    monkeypatch.setattr(Word2Vec, "fit", whole_on_the_driver)
    monkeypatch.setattr(skipgram, "SPREAD_WORDS", 8)          # 21 words: three blocks
    monkeypatch.setattr(skipgram, "RATES", (0.1, 0.01))       # few sales
    rng = np.random.default_rng(3)
    rows = [(f"c{c}", i + 1, f"{'ab'[c % 2]}{rng.integers(10)}") for c in range(300) for i in range(20)]
    rows += [("lone", 1, "often"), ("alone", 1, "often"), ("lone", 2, "once")]
    seq = spark.createDataFrame(rows, "ClientID string, Position long, ProductID string")
    vectors = sequences.train_prod2vec(seq, epochs=6)
    found = {r.ProductID: np.array(r.embedding) for r in vectors.collect()}
    assert len(found) == 21 and "often" in found and "once" not in found        # an item without a neighbour keeps its start
    assert all(v.shape == (32,) and np.isfinite(v).all() and v.any() for v in found.values())
    near = lambda x, y: float(found[x] @ found[y] / np.linalg.norm(found[x]) / np.linalg.norm(found[y]))
    own = np.mean([near(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(10) for j in range(i)])
    other = np.mean([near(f"a{i}", f"b{j}") for i in range(10) for j in range(10)])
    assert own > other + 0.3
    again = {r.ProductID: r.embedding for r in sequences.train_prod2vec(seq.repartition(5), epochs=6).collect()}
    assert all(again[p] == list(v) for p, v in found.items())
