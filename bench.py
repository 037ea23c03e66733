"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` (default 8), forcing full
evaluation with the ``noop`` sink, and prints one JSON line:
``{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}``.

Each time covers building the plan (including eager validation jobs) and
running it. The list is run twice in one JVM: ``queries``/``value`` are the
second (JIT-warm) pass, ``cold_queries``/``cold_total`` the first. The
stored task table is derived once before timing starts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "full_analysis", "polygon_coverage", "classify_marked", "construction_flag_breakdown",
    "duplicate_ali_rows", "needs_work_preview", "launch_subset",
    "matched_by_ali", "only_in_one_by_ali", "conflicts_by_ali", "conflicts_by_address",
    "migration_join", "migration_summary", "migration_clean",
    "equal_split", "apply_plan", "assignment_summary", "unassigned_count", "plan_problems",
    "page",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from taskgrid.plans import registry
    from taskgrid.session import local_session

    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16,
                          app="taskgrid-bench")
    # warm up the JVM and the scan path once, untimed
    registry.QUERIES["total_records"](spark, sf_dir).collect()
    passes = []
    for _ in range(2):
        times = {}
        for key in HEADLINE:
            t0 = time.time()
            registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.time() - t0, 3)
        passes.append(times)
    cold, warm = passes
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold_total": round(sum(cold.values()), 3), "cold_queries": cold,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
