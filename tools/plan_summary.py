"""Summarise the physical plans of registered queries: operator counts, pushed filters, and any
nested-loop / cartesian joins.

usage: python tools/plan_summary.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retainlens.plans import catalog  # noqa: E402
from retainlens.session import get_session  # noqa: E402

OPS = (r"(Exchange \w+|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
       r"BroadcastNestedLoopJoin|CartesianProduct|Window\b|WindowGroupLimit|HashAggregate|ObjectHashAggregate|"
       r"SortAggregate|TakeOrderedAndProject|Scan parquet|Scan ExistingRDD|Generate|ArrowEvalPython|BatchEvalPython)")


def summarise(df) -> tuple[Counter, list[str]]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(OPS, plan)), sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = get_session()
    for name in names:
        ops, pushed = summarise(catalog.QUERIES[name](spark, sf))
        flag = "  <-- CROSS JOIN" if ops["BroadcastNestedLoopJoin"] or ops["CartesianProduct"] else ""
        print(f"{name}: " + ", ".join(f"{k}×{v}" for k, v in sorted(ops.items()))
              + (f" | pushed: {pushed}" if pushed else "") + flag)


if __name__ == "__main__":
    main()
