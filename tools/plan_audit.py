"""Print the physical-plan shape of every registered query (after execution, so the
adaptive plan is final): exchanges with their keys, join strategies, aggregate kinds,
scan widths, and any node that should never appear (cartesian / nested-loop joins,
Python evaluation).

usage: python tools/plan_audit.py [sf_dir] [key,key,...]
       AUDIT_AT_SCALE=1 python tools/plan_audit.py ...   (no size-based broadcasts, as with
       100 TB inputs: only explicitly proven broadcasts remain; exchanges keyed on a
       low-cardinality column alone are listed separately)
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
LOW_CARDINALITY = {"role", "scope", "group", "kind", "action", "resource", "op", "source", "status"}


def final_only(plan: str) -> str:
    """The plan without its "Initial Plan" blocks (lines indented below such a heading)."""
    out, skip = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        if skip is not None and line.strip() and depth >= skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = len(line) - len(line.lstrip(" :+-"))
            continue
        out.append(line)
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
    from tagwarden.session import ensure_test_checkpoint_dir, local_session
    from tagwarden.plans.queries import QUERIES

    scratch = tempfile.mkdtemp(prefix="tw-audit-", dir="/tmp")
    extra = {"spark.sql.warehouse.dir": f"{scratch}/wh"}
    at_scale = os.environ.get("AUDIT_AT_SCALE") == "1"
    if at_scale:
        extra.update({"spark.sql.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    spark = local_session(8, extra=extra)
    spark.sparkContext.setLogLevel("OFF")
    ensure_test_checkpoint_dir(spark)
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        qe = fn(spark, sf_dir)._jdf.queryExecution()
        qe.toRdd().count()  # runs this very execution, so its adaptive plan becomes final
        plan = qe.executedPlan().toString()
        assert "isFinalPlan=false" not in plan, name
        plan = final_only(plan)
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)
        keys = [re.sub(r"#\d+L?", "", k) for k in keys]
        low = [k for k in keys if set(x.strip() for x in k.split(",")) <= LOW_CARDINALITY]
        joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", plan)
        aggs = re.findall(r"(HashAggregate|ObjectHashAggregate|SortAggregate)\(", plan)
        scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        bad = [f for f in FORBIDDEN if f in plan]
        print(f"{name}:")
        print(f"  exchanges[{len(keys)}]: " + "; ".join(keys))
        if low:
            print(f"  keyed on a low-cardinality column alone: {low} (must carry aggregated/distinct rows)")
        print(f"  joins: {', '.join(sorted(set(joins))) or '-'}   aggregates: "
              f"{', '.join(sorted(set(aggs))) or '-'}   widest scan: {max((s.count(':') for s in scans), default=0)} cols"
              + (f"   FORBIDDEN: {bad}" if bad else ""))
    spark.stop()


if __name__ == "__main__":
    main()
