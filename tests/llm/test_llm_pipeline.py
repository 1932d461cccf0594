import math

import corpus_pipeline
from helpers import odd_docs
from pyspark.sql import functions as F

from shopsignal.llm import decontamination, toxicity
from shopsignal.llm.common import crc_mod, materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, docs := materialize(stage(spark, docs, SF), name))
        if name != "token_output":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"), ~(crc_mod("doc_id", 3) == 1))
    scored, _ = toxicity.score_texts(before, model)
    assert after.count() == scored.filter("predicted = 0").count()
    before, after = seen["simhash_near_dedup"]
    from test_llm_simhash import slow_components, slow_fingerprint
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in slow_components(rows)} and after.count() == after.select("doc_id").distinct().count()
    before, after = seen["benchmark_decontamination"]
    marked, _ = decontamination.mark_benchmark(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in marked.collect() if not r.contaminated}
    before, after = seen["source_mix"]

    def words(df):
        return {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).alias("n")).collect()}
    from test_llm_mixing import slow_targets
    want = {s: math.floor(t) for s, t in slow_targets(words(before)).items()}
    assert {s: n for s, n in words(after).items() if n} == {s: n for s, n in want.items() if n}
    before, after = seen["token_output"]
    assert after.count() == before.count()
    last = after.orderBy(F.desc("start")).first()
    assert last.start + last.n_tokens == after.agg(F.sum("n_tokens")).first()[0]


def test_stages_on_odd_rows(spark):
    docs = odd_docs(spark, "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = materialize(stage(spark, docs, SF), "odd")
    assert docs.count() > 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
