"""Benchmark: run the registered queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed whole through the `noop` sink (no result is pulled
to the driver) and timed once, warm: an untimed pass of every query over the
small $BENCH_WARM_DIR (default /root/testdata/sf0.01, skipped when absent or
BENCH_WARMUP=0) first loads classes and compiles the code paths. Prints one
JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialgrid.plans.catalog import QUERIES  # noqa: E402
from trialgrid.session import build_session  # noqa: E402

HEADLINE = ["type_report", "summary_by_codec", "flat_report", "chart_groups", "param_grid",
            "new_trials", "gop_segments", "enrich_trials", "progress_eta", "best_candidate"]


def run(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm_dir):
        for name in names:
            run(spark, name, warm_dir)
    run(spark, "type_report", sf_dir)  # footers of the timed tables
    times = {}
    for name in names:
        t0 = time.time()
        run(spark, name, sf_dir)
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    head = [times[n] for n in HEADLINE if n in times]
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "headline_seconds": round(sum(head), 3),
        "n_queries": len(times),
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
