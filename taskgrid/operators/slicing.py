"""Seeded rank slicing: give each row the analyst whose rank range holds it.

The source tool shuffles a table and cuts it into consecutive slices. Here
the shuffle order is the row hash ``h`` (md5 of the seed and the row's
text, see ``functions.keys``), and a *slice* is a half-open rank range
``[lo, hi)`` within a group (one retailer, or the whole table).

A global ``row_number()`` would put every row of a group through one task.
Instead the rank is resolved in two levels:

1. ``bucket = first hex digits of h``. Bucket counts per group are an
   aggregate (partially aggregated, about ``sqrt(rows)`` buckets a group), and
   a running sum over that small table gives each bucket its rank range.
2. The bucket map ``(group, bucket) -> analyst`` names the buckets that lie
   inside one slice. Rows take their analyst by one equi join on (group,
   bucket): the bucket is the salt, so a group with a third of all rows is
   spread over as many join keys as it has buckets, broadcast or not.
3. Only buckets that straddle a slice edge (at most one per edge) are ranked
   row by row. Their rows are first reduced to distinct hashes with a count
   (identical rows have identical hashes and are interchangeable), so a
   group of copies holding a third of all rows is one row here; its copies
   are re-emitted per analyst in bounded chunks spread over many tasks.

The result equals cutting ``ORDER BY h`` into the slices, at any partition
count. Nothing is counted ahead of the plan: the bucket length is an
expression of a group's row count, which a plan states or a scalar subquery
reads when the query runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskgrid.functions.keys import row_hash

CHUNK = 4096          # copies of one row emitted per output row of the explode
SALTS = 64            # join keys of a group that needs no ranks


def auto_digits(rows: Column) -> Column:
    """Bucket prefix length for a group of ``rows`` rows.

    With ``16**d`` buckets the bucket table holds up to ``16**d`` rows per
    group and an edge bucket about ``rows / 16**d``; ``d = log16(rows) / 2``
    keeps both near ``sqrt(rows)`` (1 digit for thousands of rows, 5 for a
    trillion)."""
    half = F.round(F.log(16.0, F.greatest(rows, F.lit(1)).cast("double")) / 2).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(6), half))


def with_buckets(df: DataFrame, group: Column, digits: Column | int, columns: Sequence[str],
                 seed: int | str = 0, fixed: Column | None = None) -> DataFrame:
    """``df`` plus ``_g`` (group), ``_h`` (hash) and ``_b`` (bucket).

    Where ``fixed`` is not null the row needs no rank: its hash is not computed
    and its bucket is one of a few salts that no map entry has."""
    h = row_hash(df, seed, columns)
    n = digits if isinstance(digits, Column) else F.lit(digits)
    bucket = F.substring(h, F.lit(1), n)
    if fixed is not None:
        salt = F.concat(F.lit("salt "), F.pmod(F.xxhash64(*[F.col(_q(c)) for c in columns]), F.lit(SALTS)).cast("string"))
        h = F.when(fixed.isNull(), h)
        bucket = F.when(fixed.isNull(), F.substring(h, F.lit(1), n)).otherwise(salt)
    return df.select("*", group.cast("string").alias("_g"), h.alias("_h"), bucket.alias("_b"))


def bucket_counts(df: DataFrame, group: str | None, seed: int | str = 0, digits: Column | int = 4,
                  hash_columns: Sequence[str] | None = None):
    """Rows with ``_g`` (group), ``_h`` (hash), ``_b`` (bucket), and the
    per-bucket counts with their rank range ``[_start, _end)`` in the group."""
    columns = list(hash_columns or df.columns)
    # Without a group every row is in group ''. It is written as an empty
    # prefix of a column rather than a literal: a literal key would be folded away.
    g = F.col(group) if group else F.substring(F.coalesce(df[columns[0]].cast("string"), F.lit("")), 1, 0)
    x = with_buckets(df, g, digits, columns, seed)
    return x, ranged(x)


def ranged(x: DataFrame) -> DataFrame:
    """``(_g, _b, _n, _end, _start)``: the rank range of each bucket of ``x``."""
    w = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_n").over(w)
    return (x.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
             .select("_g", "_b", "_n", end.alias("_end"), (end - F.col("_n")).alias("_start")))


def bucket_map(bc: DataFrame, slices: DataFrame) -> DataFrame:
    """``(_mg, _mb, _label, _ms)``: the analyst of each bucket inside one slice; null for a bucket on an edge."""
    col = F.col
    s = slices.select(col("_g").alias("_sg"), col("analyst").alias("_an"), col("lo").alias("_lo"), col("hi").alias("_hi"))
    ov = bc.join(s, (col("_g") == col("_sg")) & (col("_lo") < col("_end")) & (col("_hi") > col("_start")))
    inside = (col("_lo") <= col("_start")) & (col("_end") <= col("_hi"))
    return ov.select(col("_g").alias("_mg"), col("_b").alias("_mb"), F.when(inside, col("_an")).alias("_label"),
                     col("_start").alias("_ms")).distinct()


def broadcasts(df: DataFrame) -> bool:
    """False where the session turns broadcasts off."""
    return str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")) != "-1"


def assign_ranges(x: DataFrame, bc: DataFrame, slices: DataFrame, columns: Sequence[str],
                  fixed: str | None = None, bounded: bool = False) -> DataFrame:
    """Label rows of ``x`` (from ``with_buckets``) with the analyst of the
    slice holding their rank. ``slices`` has ``_g, analyst, lo, hi``; rows
    whose rank is in no slice are dropped. Rows with an analyst in column
    ``fixed`` keep that one. With ``bounded`` the caller knows that the bucket
    map is small: it is broadcast, and only rows of edge buckets are shuffled."""
    col = F.col
    known = bucket_map(bc, slices)
    small = F.broadcast if bounded and broadcasts(x) else (lambda d: d)
    on = (col("_g") == col("_mg")) & (col("_b") == col("_mb"))
    inside = small(known.filter("_label is not null").drop("_ms"))
    if fixed:
        label = F.coalesce(col(fixed), col("_label"))
        whole = x.join(inside, on, "left").filter(label.isNotNull())
        x = x.filter(col(fixed).isNull())
    else:
        label = col("_label")
        whole = x.join(inside, on)
    whole = whole.select(*[col(_q(c)) for c in columns], label.alias("analyst"))

    s = slices.select(col("_g").alias("_sg"), col("analyst").alias("_an"), col("lo").alias("_lo"), col("hi").alias("_hi"))
    d = (x.join(small(known.filter("_label is null")), on).groupBy("_g", "_b", "_ms", "_h")
          .agg(F.count(F.lit(1)).alias("_c"),
               F.any_value(F.struct(*[col(_q(c)) for c in columns])).alias("_row")))
    w = Window.partitionBy("_g", "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    e = col("_ms") + F.sum("_c").over(w)
    d = d.select("_g", "_h", "_row", e.alias("_e"), (e - col("_c")).alias("_s"))
    p = d.join(s, (col("_g") == col("_sg")) & (col("_lo") < col("_e")) & (col("_hi") > col("_s")))
    k = F.least(col("_e"), col("_hi")) - F.greatest(col("_s"), col("_lo"))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((k - 1) / CHUNK).cast("bigint"))
    p = p.select("_h", "_row", "_an", k.alias("_k"), F.explode(chunks).alias("_chunk"))
    # an explicit partition count: AQE leaves it alone, so a large copy group
    # is emitted by many tasks instead of being coalesced back into a few
    nparts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    p = p.repartition(nparts, "_h", "_chunk")
    copies = F.least(F.lit(CHUNK).cast("bigint"), col("_k") - col("_chunk") * CHUNK).cast("int")
    edge_rows = (p.select(F.explode(F.array_repeat("_row", copies)).alias("_r"), col("_an").alias("analyst"))
                  .select(*[col(f"_r.{_q(c)}").alias(c) for c in columns], "analyst"))
    return whole.unionByName(edge_rows)


def _q(name: str) -> str:
    return f"`{name}`" if not name.isidentifier() else name
