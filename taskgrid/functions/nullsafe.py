"""Null and number rules shared by every operator.

pandas semantics differ from SQL three-valued logic; these helpers make the
difference explicit so each operator states which rule it follows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The predicates below are written as IS [NOT] NULL combined with plain
# comparisons rather than ``coalesce(..., literal)``: the truth table is the
# same and never null, and Parquet can evaluate them in the scan (a coalesce
# is not a pushable filter). ``values`` never contains null.

def is_in(c: Column, values: Iterable[str]) -> Column:
    """Membership where a null value is simply *not* a member (never null)."""
    return c.isNotNull() & c.isin(list(values))


def not_in(c: Column, values: Iterable[str]) -> Column:
    """Negated membership that keeps nulls (``~Series.isin`` behaviour)."""
    return c.isNull() | ~c.isin(list(values))


def equals(c: Column, value) -> Column:
    """``c == value`` that is false (not null) for a null ``c``."""
    return c.isNotNull() & (c == value)


def differs(a: Column, b: Column) -> Column:
    """``a != b`` where a null on either side counts as different."""
    return a.isNull() | b.isNull() | (a != b)


def same(a: Column, b: Column) -> Column:
    """``a == b`` where a null on either side counts as not equal."""
    return a.isNotNull() & b.isNotNull() & (a == b)


def pct(n: Column, total: Column) -> Column:
    """Percentage with one decimal, rounded half to even.

    ``rint(n / total * 100 * 10) / 10`` on doubles; a zero total gives null
    instead of a division error.
    """
    return F.rint(n.cast("double") / F.nullif(total, F.lit(0)) * 100 * 10) / 10


def require_same_type(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raise unless ``key`` has the same Spark type on both sides.

    Comparing keys of different types silently matches nothing (or relies on
    implicit casts), so mismatches are an error.
    """
    lt = left.schema[key].dataType
    rt = right.schema[key].dataType
    if lt != rt:
        raise TypeError(
            f"key {key!r} has type {lt.simpleString()} on the left and "
            f"{rt.simpleString()} on the right"
        )
