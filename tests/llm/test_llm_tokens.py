import zlib

import numpy as np
import pytest
from helpers import ODD, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopsignal.llm import token_counts, token_output
from shopsignal.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
SPECIAL = [(20, "<|endoftext|>"), (21, "a <|endoftext|> b<|endoftext|>c <|startoftext|>"), (22, "<|STARTOFTEXT|> It's we'll 12 3,4 don't!!"), (23, "a \n b\n c 　 d \t e  f"), (24, "end ")]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_counts_query_against_the_library(spark):
    ids = library("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert got == {r.doc_id: (len(r.text.encode()), n := len(ids(r.text)), n > 2048) for r in docs}


def test_counts_odd_rows_and_cache(spark, tmp_path):
    ids, rows = library("word_bpe_49k.json"), ODD + SPECIAL
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    cache, path = str(tmp_path / "cache"), vocabulary("word_bpe_49k.json")

    def counts(counter=token_counts.word_counter):
        out = token_counts.count_tokens(df, path, cache=cache, counter=counter)
        return sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=str)
    want = sorted(((d, len((t or "").encode()), len(ids(t))) for d, t in rows), key=str)
    assert counts() == want

    def broken(path):
        def fail(texts):
            raise AssertionError("nothing is left to encode")
        return fail
    assert counts(broken) == want                            # all come from the cache
    distinct = spark.read.parquet(cache)
    assert distinct.count() == distinct.select("digest").distinct().count()
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def expected(rows, ids):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for d, t in rows:
        own = np.array([*ids(t), 2], "<u4")
        out.append((d, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    return out


def test_output_query_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op7_token_output"](spark, SF).collect()]
    assert sorted(got) == expected(docs, library("byte_bpe_50k.json"))


@pytest.mark.parametrize("block,memory", [(1 << 18, 600_000), (50, 40)])
def test_output_odd_rows(spark, tmp_path, monkeypatch, block, memory):
    monkeypatch.setattr(token_output, "MEMORY_PIECES", memory)
    rows, ids = ODD + SPECIAL, library("byte_bpe_50k.json")
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    folder = str(tmp_path / "ids")
    token_output.write_tokens(df, folder, vocabulary("byte_bpe_50k.json"), end=2, block_ids=block)
    out = token_output.read_tokens(spark, folder, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in out), key=lambda r: r[1]) == expected(rows, ids)
    assert sorted(str(r.ids) for r in out) == sorted(str([*ids(t), 2]) for _, t in rows)


def test_output_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_output.write_tokens(df, str(tmp_path / "ids"), vocabulary("byte_bpe_50k.json"), end=2)
    assert token_output.read_tokens(spark, str(tmp_path / "ids")).count() == 0


def test_piece_encoder_small_memory():
    ids = library("byte_bpe_50k.json")
    encoder = token_output.PieceEncoder(vocabulary("byte_bpe_50k.json"), 2, memory=5)
    for _, t in ODD + SPECIAL:
        flat, n = encoder.encode([t, t])
        assert flat.tolist() == [*ids(t), 2] * 2 and n.tolist() == [len(ids(t)) + 1] * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 1 << 17), st.integers(0, (1 << 60) - 1)), max_size=300))
def test_simple8b_round_trip(values):
    assert token_output.decode(token_output.simple8b(np.array(values, np.uint64))).tolist() == values


def test_simple8b_packs_and_escapes():
    assert len(token_output.simple8b(np.zeros(600, np.uint64))) == 10
    assert len(token_output.simple8b(np.array([1 << 59] * 3, np.uint64))) == 3
    with pytest.raises(ValueError):
        token_output.simple8b(np.array([1 << 60], np.uint64))


TEXT = st.text(alphabet=st.sampled_from(list("ab1,'.s \n\t 　é²!<|>")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces_and_words_are_exact(text):
    flat, _ = ENCODER.encode([text])
    assert flat.tolist() == [*BYTE_IDS(text), 2]
    assert COUNTER.counts([text.encode()]) == [len(WORD_IDS(text))]


BYTE_IDS, WORD_IDS = library("byte_bpe_50k.json"), library("word_bpe_49k.json")
ENCODER = token_output.PieceEncoder(vocabulary("byte_bpe_50k.json"), 2)
COUNTER = token_counts.WordCounter(vocabulary("word_bpe_49k.json"))


MARKED = st.text(alphabet=st.sampled_from(list("aé9 _'!#*<|>~.,\n-")), max_size=30)


@settings(max_examples=400, deadline=None)
@given(MARKED)
def test_runs_of_marks_are_exact(text):
    for t in (text, text + "<|endoftext|> x", "a" + text + " "):
        flat, _ = ENCODER.encode([t])
        assert flat.tolist() == [*BYTE_IDS(t), 2]


def test_a_frequent_id_is_dealt_to_many_parts(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i % 50} of many" if i % 2 else "the same row") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    folder = str(tmp_path / "ids")
    token_output.write_tokens(df, folder, vocabulary("byte_bpe_50k.json"), end=2)
    parts = spark.read.parquet(folder).selectExpr("part", "aggregate(transform(doc_ids, d -> int(d = 7)), 0, (a, b) -> a + b) as hot").groupBy("part").sum("hot").collect()
    assert max(r[1] for r in parts) < 400 and sum(r[1] for r in parts) == 800           # 800 rows of id 7
    out = token_output.read_tokens(spark, folder).orderBy("start").collect()
    ids = library("byte_bpe_50k.json")
    assert [r.doc_id for r in out] == sorted(d for d, _ in rows)
    assert sum(r.n_tokens for r in out) == sum(len(ids(t)) + 1 for _, t in rows) and out[-1].start + out[-1].n_tokens == sum(r.n_tokens for r in out)


def test_new_pieces_reach_the_library_together(monkeypatch):
    encoder, texts = token_output.PieceEncoder(vocabulary("byte_bpe_50k.json"), 2), []

    class Watched:
        def encode_batch_fast(self, batch, add_special_tokens):
            texts.extend(batch)
            return library_itself.encode_batch_fast(batch, add_special_tokens=add_special_tokens)
    library_itself, encoder.tokenizer = encoder.tokenizer, Watched()
    text = " ".join(f"word{i}é" for i in range(5000)) + " <|endoftext|>tail\x1c odd　space \n end\nof \t  it"
    flat, _ = encoder.encode([text, text])
    assert flat.tolist() == [*BYTE_IDS(text), 2] * 2
    assert len(texts) < 50                                   # not one for each piece


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1.'é²\t\x1c\x85　\n<|")), max_size=6) | st.sampled_from(["<|endoftext|>", "\n", token_output.FIRST]), min_size=1, max_size=12, unique=True))
def test_pieces_encoded_together_are_those_encoded_alone(pieces):
    ids, sizes = ENCODER._library(pieces)
    alone = [BYTE_IDS(p[1:] if p[:1] == token_output.FIRST else " " + p) for p in pieces]
    assert ids.tolist() == [i for own in alone for i in own] and sizes.tolist() == [len(own) for own in alone]
