"""Benchmark the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is built in
a fresh context (so its own sub-jobs count) and forced with the noop sink.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shopsignal.plans import context as ctxmod  # noqa: E402
from shopsignal.plans.catalog import build_query  # noqa: E402
from shopsignal.session import get_session  # noqa: E402

HEADLINE = [
    "country_kpis", "master_join", "days_since_last", "pareto_revenue", "rfm_scores", "personas",
    "affinity_matrix", "product_tiers", "trending_scores", "store_trending_recs", "assoc_rules_family",
    "markov_transitions", "recommendations", "country_insights", "client_360", "cosine_topk",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    # warm-up (one pass, not timed): JVM JIT, parquet footers, codegen caches
    for name in ("master_join", "country_kpis"):
        build_query(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        ctxmod.clear()
        t0 = time.time()
        build_query(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
