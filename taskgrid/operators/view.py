"""Result viewing: fixed-size pages (V1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 50
SHALLOW = 10_000   # rows that a top-k may keep per task
CUTS = 31          # range borders per round
SAMPLE = 2_000     # keys sampled for them


def _order(df: DataFrame, order_by: Sequence[str] | None) -> list[Column]:
    cols = list(order_by) if order_by else df.columns
    return [F.col(f"`{c}`").asc_nulls_first() for c in cols]


def page(df: DataFrame, number: int, order_by: Sequence[str] | None = None,
         size: int = PAGE_SIZE, shallow: int = SHALLOW) -> DataFrame:
    """Rows of page ``number`` (0-based) under a total order (default: all
    columns, nulls first).

    A page within the first ``shallow`` rows is a per-task top-k merged once. A
    deeper one first finds the key at its rank (``key_at``) and is then a top-k
    of ``size`` rows from that key on, so no task keeps the rows before it.
    Rows of equal key are interchangeable."""
    if number < 0 or size <= 0:
        raise ValueError("page number must be ≥ 0 and size > 0")
    skip, order = number * size, _order(df, order_by)
    if skip + size <= max(shallow, size):
        return df.orderBy(*order).offset(skip).limit(size)
    found = key_at(df, skip, order_by, shallow)
    if found is None:
        return df.limit(0)
    key, before, equal = found
    cols = list(order_by) if order_by else df.columns
    own = _key(df, cols)
    at = _literal(df, cols, key)
    same = df.filter(own == at).limit(min(size, before + equal - skip))
    rest = size - (before + equal - skip)
    if rest <= 0:
        return same
    return same.unionByName(df.filter(own > at).orderBy(*order).limit(rest)).orderBy(*order)


def _key(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])


def _literal(df: DataFrame, cols: Sequence[str], key) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(f"k{i}") for i, (c, v) in enumerate(zip(cols, key))])


def key_at(df: DataFrame, rank: int, order_by: Sequence[str] | None = None,
           shallow: int = SHALLOW) -> tuple[tuple, int, int] | None:
    """(key, rows before it, rows of that key) of the row at ``rank`` (0-based), or None beyond the last row.

    Order statistics by range counts: each round samples at most about ``SAMPLE``
    keys of the range that holds the rank, takes ``CUTS`` of them as borders, and
    counts the rows between borders and on them in one aggregate. The range
    shrinks to about 1/``CUTS`` each round; one of at most ``shallow`` rows is
    sorted. Copies of one key lie on a border as soon as it is drawn, so a key
    with a third of all rows ends the search."""
    cols = list(order_by) if order_by else df.columns
    order = _order(df, order_by)
    own = _key(df, cols)
    rows, skip, low, seed = df, rank, 0, 0
    n = df.count()
    if rank >= n:
        return None
    while n > shallow:
        sample = rows.select(own.alias("k")).sample(min(1.0, SAMPLE / n), seed).limit(2 * SAMPLE)
        drawn = [tuple(r["k"]) for r in sample.orderBy("k").collect()]
        seed += 1
        if not drawn:
            continue
        cuts = list(dict.fromkeys(drawn[i * len(drawn) // CUTS] for i in range(CUTS)))

        def place(lo: int, hi: int) -> Column:
            """2 j + 1 on cut j, 2 j below it and above cut j - 1, by halving."""
            if lo == hi:
                return F.lit(2 * lo)
            mid = (lo + hi) // 2
            cut = _literal(df, cols, cuts[mid])
            return F.when(own < cut, place(lo, mid)).when(own == cut, 2 * mid + 1).otherwise(place(mid + 1, hi))
        counts = {r["p"]: r["n"] for r in rows.groupBy(place(0, len(cuts)).alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        for p in sorted(counts):
            if skip < counts[p]:
                break
            skip -= counts[p]
            low += counts[p]
        if p % 2:
            return cuts[p // 2], low, counts[p]
        if p // 2 < len(cuts):
            rows = rows.filter(own < _literal(df, cols, cuts[p // 2]))
        if p:
            rows = rows.filter(own > _literal(df, cols, cuts[p // 2 - 1]))
        n = counts[p]
    key = tuple(rows.orderBy(*order).offset(skip).limit(1).select(own.alias("k")).first()["k"])
    at = _literal(df, cols, key)
    less, same = rows.agg(F.count_if(own < at), F.count_if(own == at)).first()
    return key, low + less, same


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``rows`` and ``pages = ceil(rows / size)``."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.ceil(n / size).cast("bigint").alias("pages"))
