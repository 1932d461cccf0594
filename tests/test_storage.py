"""Stored artefacts: what a refresh rewrites, which files a filter reads, and lookups without an exchange."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from shopsignal.plans import storage

SCHEMA = "StoreCountry string, ClientID string, Amount long"


def files(root):
    return {os.path.relpath(f, root): os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/*/*.parquet")}


def country(path):
    return path.split("/")[0].split("=")[1]


def test_only_changed_countries_are_rewritten(spark, tmp_path):
    rows = [(c, f"c{i}", i) for c in ("FRA", "DEU", "IT A/L", None) for i in range(50)]
    root = str(tmp_path / "t")
    first = storage.refresh(spark.createDataFrame(rows, SCHEMA), root)
    assert set(first.rewritten) == {"FRA", "DEU", "IT A/L", None} and not first.kept and not first.removed
    before = files(root)
    again = storage.refresh(spark.createDataFrame(rows[::-1], SCHEMA), root)          # the same rows in another order
    assert not again.rewritten and set(again.kept) == set(first.rewritten) and files(root) == before
    later = [(c, i, n + (c == "DEU" and n == 7)) for c, i, n in rows if c != "IT A/L"] + [("ESP", "new", 1)]
    done = storage.refresh(spark.createDataFrame(later, SCHEMA), root)
    assert set(done.rewritten) == {"DEU", "ESP"} and done.removed == ["IT A/L"] and set(done.kept) == {"FRA", None}
    after = files(root)
    assert {f for f in before if country(f) in ("FRA", "__HIVE_DEFAULT_PARTITION__")} == {f for f in after if after[f] == before.get(f)}
    stored = storage.read_by_country(spark, root, SCHEMA).select("StoreCountry", "ClientID", "Amount").collect()
    assert sorted(map(tuple, stored), key=str) == sorted(later, key=str)
    storage.refresh(spark.createDataFrame([r for r in later if r[0]], SCHEMA), root)
    assert storage.read_by_country(spark, root, SCHEMA).filter("StoreCountry is null").count() == 0


def test_large_countries_are_dealt_to_files_of_bounded_size(spark, tmp_path):
    df = spark.range(10_000).select(F.when(F.col("id") < 9_000, "FRA").otherwise("DEU").alias("StoreCountry"), F.col("id").cast("string").alias("ClientID"), F.col("id").alias("Amount"))
    root = str(tmp_path / "t")
    storage.refresh(df, root, rows_per_file=1_000)
    sizes = {f: spark.read.parquet(f"{root}/{f}").count() for f in files(root)}
    assert max(sizes.values()) <= 1_000 and sum(sizes.values()) == 10_000
    assert 9 <= sum(country(f) == "FRA" for f in sizes) <= 27 and sum(country(f) == "DEU" for f in sizes) <= 3
    plan = storage.read_by_country(spark, root, df.schema).filter("StoreCountry = 'DEU'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(StoreCountry" in plan


def test_too_many_values_are_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "MAX_VALUES", 5)
    with pytest.raises(ValueError, match="StoreCountry"):
        storage.refresh(spark.createDataFrame([(str(i), "c", 1) for i in range(6)], SCHEMA), str(tmp_path / "t"))


def test_lookups_read_one_bucket_and_joins_need_no_exchange(spark, tmp_path):
    features = spark.range(1_000).select(F.col("id").cast("string").alias("ClientID"), F.col("id").alias("Spent"))
    cards = features.select("ClientID", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("Rank"))
    tables = storage.store_bucketed({"client_features": features, "recommendation_cards": cards}, "t", buckets=8, folder=lambda n: str(tmp_path / n))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        page = storage.client_page(spark, tables)
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert page.count() == 3_000
        one = storage.lookup(spark, tables["recommendation_cards"], "42")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")       # so that the plan names the buckets
        assert "SelectedBucketsCount: 1 out of 8" in storage.lookup(spark, tables["recommendation_cards"], "42")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "PushedFilters: [IsNotNull(ClientID), EqualTo(ClientID,42)]" in one._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.Rank for r in one.collect()) == [1, 2, 3]
        # no other bucket's file is opened
        own = {r.f for r in one.select(F.input_file_name().alias("f")).collect()}
        others = [f for f in glob.glob(str(tmp_path / "recommendation_cards" / "*.parquet")) if not any(f in x for x in own)]
        assert len(own) == 1 and len(others) == 7
        kept = {f: open(f, "rb").read() for f in others}
        for f in others:
            with open(f, "r+b") as out:
                out.write(b"junk")
        assert storage.lookup(spark, tables["recommendation_cards"], "42").count() == 3
        for f, data in kept.items():
            with open(f, "wb") as out:
                out.write(data)
        assert [r.Rank for r in storage.client_page(spark, tables, "7").orderBy("Rank").collect()] == [1, 2, 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in tables.values():
            spark.sql(f"DROP TABLE {t}")
