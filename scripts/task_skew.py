"""Per-query task balance from Spark's event log.

Runs the registered queries (noop sink) with the event log written to a fresh
scratch folder, then reads the log back: for every stage, the records a task
read (scan input + shuffle input) and the largest task's share of the stage.
Stages that process few records (final small sorts, single-row aggregates)
are ignored. Prints one JSON object: per query, the worst share among its
non-trivial stages.

    python scripts/task_skew.py [sf_dir] [min_records] [name ...]

With TASK_SKEW_NO_COALESCE=1, AQE's merging of small shuffle partitions is
switched off, so the report shows the plan's own partitioning rather than
AQE's choice to run a few megabytes in one task.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trialgrid.plans.catalog import QUERIES  # noqa: E402
from trialgrid.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    min_records = int(sys.argv[2]) if len(sys.argv) > 2 else 50_000
    names = sys.argv[3:] or list(QUERIES)
    log_dir = tempfile.mkdtemp(prefix="tg-eventlog-")
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
             "spark.eventLog.compress": "false"}
    if os.environ.get("TASK_SKEW_NO_COALESCE") == "1":
        extra["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    spark = build_session(extra=extra)
    sc = spark.sparkContext
    for name in names:
        sc.setJobDescription(name)
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_query, task_records = {}, defaultdict(list)
    # Spark 4 writes rolling logs: a folder of event files per application.
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_query[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    task_records[ev["Stage ID"]].append((
                        (m.get("Input Metrics") or {}).get("Records Read", 0),
                        (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)))
    # Scan stages are split by the input files' layout (a one-row-group file is
    # one task whatever the plan); shuffle stages show the plan's partitioning.
    worst = {"scan": {}, "shuffle": {}}
    for sid, recs in task_records.items():
        q = stage_query.get(sid)
        if q is None:
            continue
        for kind, idx in (("scan", 0), ("shuffle", 1)):
            vals = [r[idx] for r in recs]
            total = sum(vals)
            if total < min_records:
                continue
            share = max(vals) / total
            if share > worst[kind].get(q, (0, 0, 0))[0]:
                worst[kind][q] = (round(share, 3), total, len(vals))
    report = {kind: {q: {"max_task_share": s, "stage_records": t, "tasks": n}
                     for q, (s, t, n) in sorted(w.items())} for kind, w in worst.items()}
    flagged = [q for q, v in report["shuffle"].items() if v["max_task_share"] > 0.5]
    print(json.dumps({"sf_dir": sf_dir, "min_records": min_records, "shuffle_stages": report["shuffle"],
                      "scan_stages": report["scan"], "shuffle_over_half": flagged}))


if __name__ == "__main__":
    main()
