import random

import pytest
from helpers import ODD, odd_docs

from shopsignal.llm import decontamination
from shopsignal.llm.decontamination import mark_benchmark, words_of


def slow(docs, items, window):
    patterns = {}
    for k, t in items:
        w = words_of((t or "").encode())
        if k is not None and w:
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                patterns.setdefault(tuple(w[i:i + m]), set()).add(str(k))
    out = []
    for d, t in docs:
        w, hit, own = words_of(t.encode() if t is not None else None), set(), set()
        for p, ks in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i:i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    own |= ks
        out.append((d, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def fast(df, bench, **options):
    out, n = mark_benchmark(df, bench, **options)
    assert out.columns[:len(df.columns)] == df.columns
    return sorted(((r.doc_id, r[n["n_words"]], r[n["n_hit"]], sorted(r[n["items"]]), r[n["contaminated"]]) for r in out.collect()), key=str)


@pytest.mark.parametrize("window,shard", [(3, 1 << 20), (4, 60), (13, 90)])
def test_random_texts(spark, window, shard):
    rnd = random.Random(window)
    items = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 18)))) for i in range(25)] + [(3, "a b"), (None, "c d"), (99, None)]
    docs = [(i, "\n".join(" ".join(rnd.choice("abcdE") for _ in range(rnd.randint(0, 25))) for _ in range(3))) for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert fast(df, bench, window=window, shard_words=shard) == slow(docs, items, window)


def test_odd_rows(spark, monkeypatch):
    items = [(1, "PLAIN words, here; and MORE"), (2, "x0 w5"), (3, "no id"), (4, "x" * 70_000), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd_docs(spark, "n_hit")
    monkeypatch.setattr(decontamination, "LANE_WORDS", 100)
    assert fast(df, bench) == slow(ODD, items, 13)
    assert all(r[2] == 0 for r in fast(df, bench.limit(0)))
    assert fast(df.limit(0), bench) == []


def test_clashing_names_in_every_pass(spark):
    """Columns named like those that a pass adds, with one shard and with several."""
    docs = [(i, f"alpha beta gamma delta {i} epsilon zeta", "own", i, [i]) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _n string, _H long, `_i` array<long>")
    bench = spark.createDataFrame([(1, "beta gamma delta"), (2, "epsilon zeta"), (3, "alpha beta")], "item_id long, text string")
    want = slow([(d[0], d[1]) for d in docs], [(1, "beta gamma delta"), (2, "epsilon zeta"), (3, "alpha beta")], 3)
    for words in (1_000, 3):
        assert fast(df, bench, window=3, shard_words=words) == want
        out, _ = mark_benchmark(df, bench, window=3, shard_words=words)
        assert sorted(tuple(r)[2:5] for r in out.collect()) == sorted((d[2], d[3], d[4]) for d in docs)


def test_long_items_are_cut(spark):
    rnd = random.Random(1)
    text = " ".join(rnd.choice("abc") for _ in range(400))
    items = [(1, text), (2, text[100:300]), (3, "a b"), (4, text)]
    docs = [(i, text[a:a + 60]) for i, a in enumerate(range(0, 700, 37))] + [(99, text)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert fast(df, bench, window=5, shard_words=300) == slow(docs, items, 5)


def test_pieces_have_the_windows_of_their_item():
    import pyarrow as pa
    for n in range(0, 30):
        words = [b"w%d" % i for i in range(n)]
        batch = pa.RecordBatch.from_pydict({"item": ["x"], "text": [b" ".join(words).decode()]})
        for window, most in ((5, 5), (5, 6), (5, 12), (1, 4), (13, 13)):
            found = []
            for out in decontamination._cut([batch], window, most):
                for size, text in zip(out.column("n").to_pylist(), out.column("words").to_pylist()):
                    own = text.split(b" ")
                    assert size == len(own) <= max(most, window)
                    m = min(window, len(own))
                    found += [tuple(own[i:i + m]) for i in range(len(own) - m + 1)]
            m = min(window, n)
            assert found == [tuple(words[i:i + m]) for i in range(n - m + 1) if m], (n, window, most)


def test_search_tables_take_a_bounded_number_of_bytes_a_word():
    import tracemalloc
    rnd = random.Random(2)
    words = [b"w%d" % rnd.randrange(20_000) for _ in range(200_000)]
    items = [(str(k), words[a:a + 200]) for k, a in enumerate(range(0, 200_000, 200))]
    tracemalloc.start()
    s = decontamination.Searcher(items, 13)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200 * 200_000 and held < 60 * 200_000 + 20_000 * 200, (peak / 200_000, held / 200_000)
    assert len(s.classes) == 1
