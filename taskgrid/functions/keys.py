"""Deterministic row keys used for reproducible random splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARK = "-"


def row_hash(df: DataFrame, seed: int | str = 0,
             columns: Sequence[str] | None = None) -> Column:
    """md5 over the seed and every column rendered as text.

    Each value is written as its length, a colon and its text, a null as ``-``,
    so different rows never have the same text. Rows with equal hashes are then
    identical rows (up to md5 collisions), and ordering by this key is a seeded
    shuffle that any engine can reproduce.
    """
    cols = list(columns) if columns is not None else df.columns
    parts = [F.lit(str(seed))]
    for c in cols:
        text = df[c].cast("string")  # one cast per value: both uses are in an always evaluated branch
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit(NULL_MARK)))
    return F.md5(F.concat_ws("|", *parts))
