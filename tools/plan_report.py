"""Summarise the physical plan of every registered query (after execution, so AQE's
final plan is shown): shuffles, broadcast joins, sort-merge joins, windows, scans and
the filters pushed into Parquet.  Usage: python tools/plan_report.py [sf_dir] > PLANS.md
(collects each result, so use it at test scales only)
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)})
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bhj": plan.count("BroadcastHashJoin"),
        "smj": plan.count("SortMergeJoin"),
        "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "windows": plan.count("Window ["),
        "scans": len(re.findall(r"FileScan parquet|Scan ExistingRDD", plan)),
        "pushed": pushed,
    }


DETAIL = ["top_cities", "seller_scorecard", "delivery_box_stats"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tradelens.plans.catalog import queries
    from tradelens.session import build_session

    spark = build_session(8, 16, "plan-report")
    print(f"# Physical plans at {os.path.basename(sf)} (final AQE plans)\n")
    print("Generated by `tools/plan_report.py`. Columns: hash/range shuffles, single-partition exchanges "
          "(global aggregates' final merge or top-k), broadcast hash joins, sort-merge joins, nested-loop or "
          "cartesian joins, window operators, scans (Parquet files or checkpoints), filters pushed into the "
          "Parquet scans.  Sort-merge joins left in a final plan are joins whose both sides exceeded the "
          "broadcast threshold at run time.\n")
    print("| query | shuffles | single | BHJ | SMJ | NLJ | windows | scans | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    finals: dict[str, str] = {}
    for key, fn in queries().items():
        df = fn(spark, sf)
        df.collect()   # runs this DataFrame's own plan, so AQE's final plan is recorded on it
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "== Final Plan ==" in plan:
            plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
        s = summarise(plan)
        pushed = "; ".join(x for x in s["pushed"] if x.strip())[:160]
        print(f"| {key} | {s['shuffles']} | {s['single']} | {s['bhj']} | {s['smj']} | {s['bnlj']} | "
              f"{s['windows']} | {s['scans']} | {pushed} |")
        finals[key] = plan
    for key in DETAIL:
        if key in finals:
            body = re.sub(r"#\d+L?", "", finals[key]).strip("\n")
            body = re.sub(r"Location: [^,]+, ", "", body)
            print(f"\n## Final plan: {key}\n\n```\n{body}\n```")


if __name__ == "__main__":
    main()
