"""Benchmark the headline operators; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs to completion through the no-op sink (full execution, no
driver collect). Throughput is reported in requests/s for the batch
operators, next to wall time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["load_addresses", "resolve_hierarchy", "streets_by_suburb", "verify", "nearest_address",
            "autocomplete", "regions_browse"]
# request table of each batch operator (rows counted for requests/s)
REQUESTS = {"verify": "customer", "nearest_address": "customer", "autocomplete": "customer",
            "resolve_hierarchy": "orders", "load_addresses": "orders", "streets_by_suburb": "orders"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from addrgrid.plans.catalog import QUERIES
    from addrgrid.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times, rates = {}, {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        dt = time.time() - t0
        times[name] = round(dt, 3)
        print(f"{name}: {dt:.1f}s", file=sys.stderr, flush=True)
        tbl = REQUESTS.get(name)
        if tbl:
            n = spark.read.parquet(f"{sf_dir}/{tbl}.parquet").count()
            rates[name] = round(n / dt, 1) if dt > 0 else None
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "requests_per_sec": rates, "sf": float(m.group(1)) if m else sf_dir,
           "master": spark.sparkContext.master, "cores": cpus, "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
