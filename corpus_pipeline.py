"""A training corpus from ``documents``: five stages, each written as parquet and read again.

toxicity                  rejects documents that the string-kernel machine scores 0.7 or more
simhash_near_dedup        keeps one document of each class of near duplicates
benchmark_decontamination rejects documents of which a twentieth lies in benchmark windows
source_mix                repeats and cuts sources to their target weights
token_output              encodes what is left and reports each document's place in the files
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.llm import decontamination, mixing, simhash, token_output, toxicity
from shopsignal.llm.common import crc_mod, materialize, shared_folder, table
from shopsignal.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    scored, names = toxicity.score_texts(docs, model)
    return scored.filter(F.col(names["predicted"]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked, names = decontamination.mark_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col(names["contaminated"])).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed_documents(docs)
    # the documents at a cut are shorter now
    return out.withColumn("n_chars", F.least("n_chars", F.length("text"))) if "n_chars" in out.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "corpus-token-ids")
    # smaller than by default: the workers have been through four stages already
    token_output.write_tokens(docs, folder, vocabulary("byte_bpe_50k.json"), end=2, step=2 << 20, memory=500_000)
    return token_output.read_tokens(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", encode_tokens),
]

#: toxicity scores, SimHash classes and token ids are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
