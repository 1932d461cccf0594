"""The registered queries: each applies its operator to the whole intended table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignal.llm import conversation_repair, decontamination, knn_join, language_id, license_scan, mixing, prefix_trie, simhash, substring_dedup, token_counts, token_output, toxicity, url_filter
from shopsignal.llm.common import crc_mod, shared_folder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, names = license_scan.scan(docs, license_scan.learn(docs), keep=["doc_id"])
    licenses = F.col(names["licenses"])
    return out.select("doc_id", names["paragraphs"], F.size(licenses).cast("long").alias("n_licensed"), F.array_join(F.array_sort(F.array_distinct(licenses)), ",").alias("families"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language_id.learn(docs, ~held)
    out, names = language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), *names.values())


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-ids")
    token_output.write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end=2)
    return token_output.read_tokens(spark, folder)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_inner_products(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, _ = decontamination.mark_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held)
    out, names = toxicity.score_texts(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), *names.values())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie.trie(*prefix_trie.share_openings(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long"), "n_leaves", "saved_tokens", "ends_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage_by_hash(table(spark, sf_dir, "conversations"))
    out = conversation_repair.conversations(*conversation_repair.repair(damaged, present="present"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0)).alias("gaps")
    return out.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: rules of the query: the stated sites, then patterns for hosts that trade in nothing worth reading
SITE_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
JUNK_HOSTS = ["casino", "poker", "free-bets", "cheap-pills", "adult", "porn", "xxx", "ads-track", "adserver", "spam", "spam-farm"]


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITE_RULES + [(f"~||{h}^", "block") for h in JUNK_HOSTS], "rule string, verdict string")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_rules(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_source_mix, op3_token_counts, op4_license_scan, op5_simhash, op6_language_id,
                            op7_token_output, op8_exact_topk, op9_decontamination, op10_toxicity,
                            op11_prefix_trie, op12_conversation_repair, op13_url_filter)}
