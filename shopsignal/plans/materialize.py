"""Materialise the precomputed artefacts (the dashboard's inputs) as parquet tables.

One write per table; the sale-level table is partitioned by StoreCountry so country filters
prune files. The output folder is a parameter; by default it lies in the shared folder that
``spark.checkpoint.dir`` names (a temporary one only in local sessions without it).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignal.operators import baskets, bi, customers, features
from shopsignal.plans.context import Ctx
from shopsignal.session import ensure_checkpoint_dir


def artefacts(x: Ctx) -> dict[str, tuple[DataFrame, list[str]]]:
    r = x
    wide = features.add_cross_border(features.add_price_features(bi.final_features(x.master, x.rfm)))
    # both ordered scans see the row key alone and are joined to the wide rows once
    final = features.add_by_row_key(wide, lambda rows: features.add_pareto(features.add_days_since_last(rows)))
    return {
        "final_data": (final, ["StoreCountry"]),
        "persona": (r.persona_enriched, []),
        "client_features": (customers.client_features(r.persona_enriched, r.rfm), []),
        "associations": (baskets.bundles_wide(x.rules_family), []),
        "associations_long": (x.rules_family, []),
        "popular": (x.popular, []),
        "trending": (x.trending, []),
        "affinity": (customers.affinity_matrix(x.master), []),
        "country_kpis": (bi.country_kpis(x.master), []),
        "country_trending": (bi.country_trending(x.trend_scores, x.t.products), []),
        "markov": (x.markov, []),
        "markov_global": (x.markov_global, []),
        "embeddings": (x.embeddings, []),
        "metadata": (bi.dataset_metadata(x.master, x.clients, x.products), []),
    }


def default_root(x: Ctx) -> str:
    root = ensure_checkpoint_dir(x.spark).rstrip("/")
    name = x.sf_dir.rstrip("/").split("/")[-1]
    return f"{root}/shopsignal_materialized/{name}"


def materialize(x: Ctx, root: str | None = None, tables: list[str] | None = None) -> DataFrame:
    """Write the artefacts and return (table, rows) read back from what was written."""
    root = root or default_root(x)
    arts = artefacts(x)
    names = tables or list(arts)
    summaries = []
    for name in names:
        df, parts = arts[name]
        w = df.write.mode("overwrite")
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{root}/{name}")
        back = x.spark.read.schema(df.schema).parquet(f"{root}/{name}")
        summaries.append(back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out


OPTIONAL = {"country_trending"}


def read_artefacts(spark, root: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """Read materialised artefacts back. A missing optional table comes back as an empty
    DataFrame with its schema (taken from ``schemas``), a missing required one raises."""
    from pyspark.errors import AnalysisException
    out = {}
    names = list(schemas or {}) or ["final_data", "persona", "client_features", "associations", "popular",
                                    "trending", "affinity", "country_kpis", "country_trending", "metadata"]
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{root.rstrip('/')}/{name}")
        except AnalysisException:
            if name not in OPTIONAL:
                raise
            schema = (schemas or {}).get(name, "StoreCountry string, ProductID string, FinalScore double")
            out[name] = spark.createDataFrame([], schema)
    return out
