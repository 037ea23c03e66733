"""Execute every registered query and summarise its final (AQE) plan.

    python tools/plan_report.py [sf_dir] > PLANS.md

Per query: exchanges, join strategies, aggregate kinds, windows, and for each
Parquet scan the number of columns read and the filters pushed to it. A
second table repeats the join-heavy queries with broadcasts switched off, the
shape their plans take when both sides are large.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"read_tasks_csv", "read_tasks_csv_rejects", "union_sheets", "union_sheets_inferred", "inferred_types",
        "write_table", "write_assignments", "write_assignments_summary"}  # write files first


def summarise(plan: str) -> dict:
    # an adaptive plan prints its final plan and then the initial one
    plan = plan.split("== Initial Plan ==")[0]
    scans = []
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.*?), ReadSchema", plan):
        cols = len([c for c in m.group(1).split(",") if c.strip()])
        pushed = m.group(2).strip().rstrip("]")
        scans.append(f"{cols} cols" + (f", pushed: {pushed[:60]}" if pushed else ""))
    reused = plan.count("ReusedExchange")  # printed with the text of the exchange it reuses
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin",
                                   plan)) - reused,
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "joins": ", ".join(f"{n}×{k}" for k, n in sorted(
            {j: len(re.findall(j, plan)) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                                    "BroadcastNestedLoopJoin", "CartesianProduct")}.items())
            if n) or "–",
        "aggs": ", ".join(f"{n}×{k}" for k, n in sorted(
            {a: len(re.findall(a + r"\(", plan)) for a in ("HashAggregate", "SortAggregate",
                                                             "ObjectHashAggregate")}.items()) if n) or "–",
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "reused": reused,
        "scans": "; ".join(sorted(set(scans))) or "–",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from taskgrid.plans import registry
    from taskgrid.session import local_session
    spark = local_session(8, shuffle_partitions=16)
    print(f"# Final query plans ({sf_dir}, local[8], AQE on)\n")
    print("Generated by `tools/plan_report.py`: each query is executed, then its final adaptive plan "
          "is summarised. Shuffles count hash/range exchanges (AQE may have turned others into "
          "broadcasts). Scans list the columns read and the filters pushed into Parquet. Queries that "
          "write files first are skipped.\n")
    print("| query | shuffles | broadcasts | joins | aggregates | windows | parquet scans |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for key in sorted(registry.QUERIES):
        if key in SKIP:
            continue
        df = registry.QUERIES[key](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| `{key}` | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | {s['aggs']} | "
              f"{s['windows']} | {s['scans']} |", flush=True)


    print("\n## Join-heavy queries with broadcasts off\n")
    print("Both broadcast thresholds set to -1, as when both inputs are large. `reused` counts "
          "exchanges Spark reuses instead of shuffling the same input twice.\n")
    print("| query | shuffles | reused | joins | aggregates |")
    print("| --- | --- | --- | --- | --- |")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    for key in ("duplicate_ali_rows", "matched_by_ali", "only_in_one_by_ali", "conflicts_by_ali",
                "migration_join", "migration_only_old", "migration_clean", "migration_summary",
                "launch_subset", "unassigned_count"):
        df = registry.QUERIES[key](spark, sf_dir)
        df.collect()
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{key}` | {s['shuffles']} | {s['reused']} | {s['joins']} | {s['aggs']} |", flush=True)


if __name__ == "__main__":
    main()
