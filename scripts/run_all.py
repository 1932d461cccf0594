"""Run every catalog query at one scale, print rows and seconds (a local smoke run)."""
import sys
import time

from shopsignal.plans.catalog import QUERIES, build_query
from shopsignal.session import get_session

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
spark = get_session("local[8]", 8)
for name in only:
    t = time.time()
    try:
        df = build_query(name, spark, sf)
        n = df.count()
        print(f"OK   {name:28s} rows={n:<8d} {time.time()-t:6.1f}s", flush=True)
    except Exception as e:  # noqa: BLE001
        print(f"FAIL {name:28s} {type(e).__name__}: {str(e)[:300]}", flush=True)
