"""The three end-to-end flows: analyse an upload, launch work, compare lists.

Each returns ``dict[str, DataFrame]``. ``analysis`` persists the small shared
intermediates (the fused summary row, the per-retailer profile) while a block
reads them, and releases them after it; the large inputs are never persisted.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskgrid.config import DEFAULT, TaskConfig
from taskgrid.operators import assign, compare as cmp, quality as q


def analyse(df: DataFrame, cfg: TaskConfig = DEFAULT, flag_values: Sequence[str] | None = None,
            status_values: Sequence[str] | None = None, keep: bool = False) -> dict[str, DataFrame]:
    """The full analysis of one task list.

    Two passes over the data serve every aggregate: the fused scalar row and
    the per-retailer profile. Percent tables are read off the fused row. With
    ``keep`` both are persisted; ``analysis`` does that and releases them."""
    summary = q.full_analysis_row(df, cfg)
    profile = q.retailer_profile(df, cfg)
    if keep:
        summary, profile = summary.persist(), profile.persist()
    out = {"summary": summary, "unique_retailers": q.unique_retailers(df, cfg), "profile": profile}
    out.update(q.from_profile(profile, cfg, flag_values, status_values))

    def stack(items):
        return summary.select(F.inline(F.array(*[
            F.struct(F.lit(label).alias("label"), F.col(f"{k}_count").alias("count"),
                     F.col(f"{k}_pct").alias("pct")) for label, k in items])))

    out["construction_pct"] = stack([("Construction", "construction"), ("Mall Tenant", "mall_tenant"),
                                     ("Multi Level", "multi_level"), ("Normal", "normal")])
    out["polygon_pct"] = stack([("Verified QA", "verified_qa"), ("Unverified", "unverified")])
    out["parent_pct"] = stack([("connected", "connected"), ("unknown", "unknown")])
    out["duplicate_rows"] = q.duplicate_ali_rows(df, cfg)
    out["qc_mall_tenant_errors"] = q.qc_mall_tenant_errors(df, cfg)
    out["qc_multi_level_errors"] = q.qc_multi_level_errors(df, cfg)
    out["qc_construction_errors"] = q.qc_construction_errors(df, cfg)
    return out


@contextmanager
def analysis(df: DataFrame, cfg: TaskConfig = DEFAULT, flag_values: Sequence[str] | None = None,
             status_values: Sequence[str] | None = None):
    """``analyse`` with its two shared tables persisted for the length of a ``with`` block."""
    out = analyse(df, cfg, flag_values, status_values, keep=True)
    try:
        yield out
    finally:
        out["summary"].unpersist(blocking=True)
        out["profile"].unpersist(blocking=True)


def launch(df: DataFrame, analysts: Sequence[str], selected=None, plan=None, split_plan=None,
           seed: int | str = 0, cfg: TaskConfig = DEFAULT) -> dict[str, DataFrame]:
    """Needs-work rows of the selected retailers, divided among analysts.

    Without a plan the rows are split equally (single-retailer mode); with a
    plan whole retailers and Split retailers are assigned as planned.
    """
    rows = q.launch_subset(df, cfg, selected)
    if plan is None:
        assignments = assign.equal_split(rows, analysts, seed)
    else:
        assignments = assign.apply_plan(rows, analysts, plan, split_plan, seed, cfg)
    return {
        "rows": rows,
        "mode": assign.retailer_mode(rows, cfg),
        "retailer_counts": q.records_per_retailer(rows, cfg),
        "target": assign.split_target(rows, len(analysts)),
        "assignments": assignments,
        "summary": assign.assignment_summary(assignments, analysts, cfg),
        "sheets": assign.analyst_sheets(assignments, cfg),
        "unassigned": assign.unassigned_count(rows, assignments, cfg),
    }


def compare(df1: DataFrame, df2: DataFrame, kind: str, cfg: TaskConfig = DEFAULT,
            null_keys: str = "match") -> dict[str, DataFrame]:
    """Compare two task lists by ``ALI``, ``Address`` or ``Migration``."""
    return cmp.compare(df1, df2, kind, cfg, null_keys)


__all__ = ["analyse", "analysis", "launch", "compare"]
