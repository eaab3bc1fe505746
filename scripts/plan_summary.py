"""Summarise the physical plans of the registered queries.

For each query: shuffle exchanges, join strategies, each Parquet scan's read
columns (column pruning) and pushed filters, and whether any Python
evaluation node appears (there should be none). Markdown on stdout.

    python scripts/plan_summary.py [sf_dir] [name ...] > docs/plans.md
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trialgrid.plans.catalog import QUERIES  # noqa: E402
from trialgrid.session import build_session  # noqa: E402

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def summarise(name, text):
    lines = text.splitlines()
    joins = sorted({m.group(1) for m in re.finditer(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                                        r"BroadcastNestedLoopJoin|CartesianProduct)", text)})
    exchanges = len(re.findall(r"^\(\d+\) Exchange", text, re.M))
    scans = []
    for i, ln in enumerate(lines):
        if re.match(r"^\(\d+\) Scan parquet", ln):
            block = lines[i:i + 8]
            loc = next((b for b in block if b.startswith("Location")), "")
            table = re.search(r"/([a-z]+)\.parquet", loc)
            schema = next((b for b in block if b.startswith("ReadSchema")), "")
            pushed = next((b for b in block if b.startswith("PushedFilters")), "PushedFilters: []")
            cols = len(re.findall(r"\w+:", schema.split("struct<", 1)[-1])) if schema else 0
            scans.append(f"{table.group(1) if table else '?'}({cols} cols; {pushed.split(': ', 1)[-1]})")
    python = any(p in text for p in PY_NODES)
    return (f"| `{name}` | {exchanges} | {', '.join(joins) or '-'} | {'; '.join(sorted(set(scans))) or '-'} "
            f"| {'yes' if python else 'no'} |")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session()
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_summary.py` on `{sf_dir}` (initial adaptive plans; AQE may still switch a")
    print("sort-merge join to broadcast, coalesce partitions or split skewed ones at run time).\n")
    print("| query | exchanges | joins | parquet scans (columns read; pushed filters) | Python nodes |")
    print("|---|---|---|---|---|")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        print(summarise(name, buf.getvalue()))


if __name__ == "__main__":
    main()
