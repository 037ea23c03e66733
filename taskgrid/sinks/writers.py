"""Writers (K1–K3).

A workbook of the source tool becomes a folder: a ``summary`` table and a
``sheets`` table partitioned by analyst (one sub-folder per analyst). Jobs
write with Spark's commit protocol, so a lost executor's partial output is
never committed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, DayTimeIntervalType, DoubleType, FloatType, MapType,
                               StructType, TimestampNTZType, TimestampType)

from taskgrid.config import DEFAULT, TaskConfig
from taskgrid.sources.schema import to_display


def write_table(df: DataFrame, path: str, fmt: str = "parquet", display_names: bool = False,
                mode: str = "errorifexists", cfg: TaskConfig = DEFAULT) -> None:
    """K1: one table with a header (CSV) or a schema (Parquet), no index."""
    out = to_display(df, cfg) if display_names else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_assignments(assignments: DataFrame, analysts: Sequence[str], path: str,
                      fmt: str = "parquet", mode: str = "errorifexists",
                      cfg: TaskConfig = DEFAULT) -> None:
    """K2: ``path/sheets/analyst=<name>/`` (the 14-column analyst layout), ``path/retailers`` (analyst, retailer,
    n) and ``path/summary`` (T7).

    The summary's counts are metrics observed while the sheets are written, so the sheets are not read again for
    them. The observation stands after the rebalance, in the stage that writes: a task's numbers count once, when
    it commits. Retailer names, which no metric can hold, come from two columns of the written sheets."""
    from taskgrid.operators.assign import analyst_sheets, assignment_retailers, summary_rows

    spark, names = assignments.sparkSession, list(analysts)
    rows = analyst_sheets(assignments, cfg).withColumn("analyst", F.col("analyst").cast("string"))
    seen = Observation("sheets")
    counted = [F.count_if(F.col("analyst") == n).alias(f"a{k}") for k, n in enumerate(names)]
    # rebalance keeps an analyst's rows together but cuts a large analyst into several tasks and files
    (rows.hint("rebalance", "analyst").observe(seen, *counted).write.mode(mode).format(fmt)
        .option("header", True).partitionBy("analyst").save(f"{path}/sheets"))
    counts = [(k, n, seen.get[f"a{k}"]) for k, n in enumerate(names)]

    sheets = spark.read.format(fmt).option("header", True).schema(rows.schema).load(f"{path}/sheets")
    told = assignment_retailers(sheets.select(F.col("`List Name`").alias(cfg.list_name), "analyst"), cfg)
    told.write.mode(mode).format(fmt).option("header", True).save(f"{path}/retailers")
    told = spark.read.format(fmt).option("header", True).schema(told.schema).load(f"{path}/retailers")
    text = told.groupBy("analyst").agg(
        F.array_join(F.sort_array(F.collect_list(cfg.list_name)), ", ").alias("assigned_retailers"))
    table = spark.createDataFrame(counts, "position int, analyst string, tasks_assigned bigint")
    summary = summary_rows(table.join(text, "analyst", "left").na.fill({"assigned_retailers": ""}).select(
        "position", "analyst", "tasks_assigned", "assigned_retailers"), F.lit(sum(n for _, _, n in counts)))
    summary.coalesce(1).write.mode(mode).format(fmt).option("header", True).save(f"{path}/summary")


def _interval_text(c: Column) -> Column:
    """A day-time interval as ``D days hh:mm:ss[.ffffff]``; days round down, so a negative one reads ``-1 days +23:59:59``."""
    micros = F.round(F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint") + 60_000_000 * (
        F.extract(F.lit("MINUTE"), c) + 60 * (F.extract(F.lit("HOUR"), c) + 24 * F.extract(F.lit("DAY"), c).cast("bigint")))
    day = 86_400_000_000
    rest = F.pmod(micros, F.lit(day))
    days = F.floor((micros - rest) / day).cast("bigint")
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    second = F.floor(rest / 1_000_000).cast("bigint")
    fraction = rest - second * 1_000_000
    clock = F.concat(two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60))
    return F.concat(days.cast("string"), F.lit(" days "), F.when(days < 0, "+").otherwise(""), clock, F.when(
        fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise(""))


def _json_ready(c: Column, kind: DataType) -> Column:
    """``c`` with every float that JSON cannot hold as null and every timestamp as ISO-8601, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.abs(c) < float("inf"), c)  # NaN is above infinity
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        # the fraction only when it is not zero
        base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.date_format(c, "SSSSSS")
        return F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))
    if isinstance(kind, DayTimeIntervalType):
        return _interval_text(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _json_ready(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _json_ready(v, kind.valueType))
    if isinstance(kind, StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(
            *[_json_ready(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def json_records(df: DataFrame, column: str = "record") -> DataFrame:
    """K3: each row as one JSON object: nulls kept as ``null``, NaN and
    infinities as ``null``, timestamps in ISO-8601, day-time intervals as days
    and clock time, also inside arrays, maps and structs."""
    cols = [_json_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    opts = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}
    return df.select(F.to_json(F.struct(*cols), opts).alias(column))
