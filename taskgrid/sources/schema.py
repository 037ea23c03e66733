"""Schema operators: rename, input checks, layout projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskgrid.config import DEFAULT, TaskConfig


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """S3: rename ``{existing: required}``; names not in ``df`` are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def to_display(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Our column names → the display names of the source tool."""
    return rename_columns(df, cfg.to_display)


def from_display(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Display names → our column names."""
    return rename_columns(df, {v: k for k, v in cfg.to_display.items()})


def missing_columns(df: DataFrame, cfg: TaskConfig = DEFAULT, analyser: bool = False) -> list[str]:
    """Required columns absent from ``df``, in the required order."""
    need = cfg.analyser_required if analyser else cfg.required
    return [c for c in need if c not in df.columns]


def input_check(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """One row per required column: ``column_name``, ``required_by``
    (``upload`` or ``analyser``), ``present``, and ``has_rows`` (the table is
    not empty; found by reading at most one row)."""
    entries = [(c, "upload") for c in cfg.required] + \
              [(c, "analyser") for c in cfg.analyser_required if c not in cfg.required]
    probe = df.select(F.lit(1).alias("_x")).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    return probe.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(by).alias("required_by"),
                 F.lit(c in df.columns).alias("present"), F.col("has_rows"))
        for c, by in entries])))


def validate(df: DataFrame, cfg: TaskConfig = DEFAULT, analyser: bool = False) -> None:
    """Raise if ``df`` is empty or misses required columns."""
    missing = missing_columns(df, cfg, analyser)
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    if df.isEmpty():
        raise ValueError("the table has no rows")


def available_columns(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """The comparison layout columns present in ``df``, in layout order."""
    return df.select(*[c for c in cfg.compare_layout if c in df.columns])
