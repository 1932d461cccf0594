import hashlib
import random
from collections import Counter

import numpy as np
from helpers import LONG, ODD, odd_docs

from shopsignal.llm import substring_dedup
from shopsignal.llm.substring_dedup import remove_repeated_windows


def slow(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        spans = [i for i in range(len(w) + 1) if (i in gone) != (i - 1 in gone)]
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans[::2], spans[1::2]))
    return sorted(out, key=str)


def fast(df, window):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest(), r.starts, r.ends)
                   for r in remove_repeated_windows(df, window=window).collect()), key=str)


def test_random_texts_and_small_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    passage = " ".join(rnd.choice("abcdefgh") for _ in range(30))
    docs = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))) + (" " + passage if i % 4 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert fast(df, 5) == slow(docs, 5)
    assert fast(df, 12) == slow(docs, 12)
    monkeypatch.setattr(substring_dedup, "SLOT_WINDOWS", 8)
    assert fast(df, 12) == slow(docs, 12)


def test_odd_rows(spark):
    df = odd_docs(spark, "n_words")
    assert fast(df, 35) == slow(ODD, 35)
    assert remove_repeated_windows(df.limit(0)).count() == 0
    self_repeat = [(1, LONG + " " + LONG)]
    assert fast(spark.createDataFrame(self_repeat, "doc_id long, text string"), 35) == slow(self_repeat, 35)


def test_windows_of_equal_64_bit_hash_are_not_repeats(spark):
    """A Thue-Morse sequence and its complement collide in every polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = [" ".join(pair[b] for b in bits) for pair in (("red", "blue"), ("blue", "red"))]
    hashes = []
    for t in texts:
        words = t.encode().split()
        hashes.append(int(substring_dedup.window_hashes(substring_dedup.word_hashes(words), np.array([1024]), 1024)[1][0]))
    assert hashes[0] == hashes[1]
    out = substring_dedup.remove_repeated_windows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), window=1024)
    assert [r.n_removed for r in out.collect()] == [0, 0]
    twice = spark.createDataFrame([(i, texts[0]) for i in range(2)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated_windows(twice, window=1024).collect()] == [1024, 1024]
