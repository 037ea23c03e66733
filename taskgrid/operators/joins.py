"""Join helpers shared by the operators.

Keys are compared null-safely (a null key equals a null key), which is how
pandas membership and merges treat missing values.

A null-safe key is carried as two plain columns, ``(value or a default,
value is null)``; joins compare both (Spark rewrites ``a <=> b`` into the
same pair).

Before a semi/anti join the key side is reduced to its distinct keys: a
partial aggregate that collapses hot keys map-side, so a key holding a third
of all rows is one row after the exchange. A hot key on the probe side is
split by AQE's skew-join handling (semi, anti, inner and left-outer joins
all qualify) — which needs *both* join inputs to be shuffle stages. So an
aggregate that feeds such a join groups by the raw key and derives the pair
afterwards: the pair is then re-shuffled (a shuffle of distinct keys only)
and the probe side stays splittable. Grouping on the pair directly would
save that shuffle but let the aggregate feed the join without an exchange,
and a hot probe key would land whole in one task. Joins between two
aggregates (one row per key on each side, nothing to split) group on the
pair (``ns_key``) and skip the extra shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _default(dt: T.DataType) -> Column:
    """A constant of type ``dt`` to stand in a null key's place."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.lit("").cast(dt)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                       T.DoubleType, T.DecimalType)):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dt)
    raise TypeError(f"unsupported key type {dt.simpleString()}")


def ns_key(df: DataFrame, key: str, prefix: str = "_k") -> tuple[Column, Column]:
    """The null-safe pair for ``df[key]``: ``(coalesce(key, default), isnull(key))``."""
    c = F.col(_q(key))
    return F.coalesce(c, _default(df.schema[key].dataType)).alias(f"{prefix}v"), c.isNull().alias(f"{prefix}n")


def ns_cond(prefix_a: str, prefix_b: str) -> Column:
    """Equality of two null-safe pairs."""
    return ((F.col(f"{prefix_a}v") == F.col(f"{prefix_b}v"))
            & (F.col(f"{prefix_a}n") == F.col(f"{prefix_b}n")))


def with_ns_key(df: DataFrame, key: str, prefix: str = "_k") -> DataFrame:
    v, n = ns_key(df, key, prefix)
    return df.withColumns({f"{prefix}v": v, f"{prefix}n": n})


def pairs_of(df: DataFrame, raw: str, dtype, prefix: str) -> DataFrame:
    """Project an aggregate's raw key column ``raw`` to a null-safe pair."""
    c = F.col(raw)
    return df.withColumns({f"{prefix}v": F.coalesce(c, _default(dtype)), f"{prefix}n": c.isNull()}).drop(raw)


def distinct_keys(df: DataFrame, key: str, prefix: str = "_r") -> DataFrame:
    """Distinct null-safe key pairs of ``df[key]`` (null is a key)."""
    dt = df.schema[key].dataType
    return pairs_of(df.select(F.col(_q(key)).alias("_raw")).distinct(), "_raw", dt, prefix)


def keyed_semi(left: DataFrame, right: DataFrame, key: str, how: str = "left_semi",
               right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose ``key`` does (``left_semi``) or does not
    (``left_anti``) occur in ``right``, null matching null."""
    return semi_on_pairs(left, key, distinct_keys(right, right_key or key, "_r"), how)


def semi_on_pairs(left: DataFrame, key: str, pairs: DataFrame, how: str = "left_semi",
                  prefix: str = "_r") -> DataFrame:
    """Semi/anti join of ``left`` on ``key`` against null-safe pairs
    (columns ``<prefix>v``, ``<prefix>n``)."""
    lt = with_ns_key(left, key, "_l")
    return lt.join(pairs, ns_cond("_l", prefix), how).select(*[F.col(_q(c)) for c in left.columns])


def repeated_keys(df: DataFrame, key: str, prefix: str = "_r") -> DataFrame:
    """Null-safe pairs of ``key`` values that occur more than once."""
    dt = df.schema[key].dataType
    reps = (df.groupBy(F.col(_q(key)).alias("_raw")).agg(F.count(F.lit(1)).alias("_cnt"))
              .filter(F.col("_cnt") > 1).drop("_cnt"))
    return pairs_of(reps, "_raw", dt, prefix)


def _q(name: str) -> str:
    return f"`{name}`" if not name.isidentifier() else name
