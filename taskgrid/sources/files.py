"""Task-list readers.

CSV files are read as text, NA tokens become null, then columns are cast to
their types. Known columns have fixed types; other columns stay text or, with
``infer``, get the narrowest type that all their values fit. ``read_checked``
also returns what did not parse, so that no value turns null unseen. Each sheet
of a multi-file ("workbook") source may have its own header; sheets are unioned
by column name, missing cells null, columns in order of first appearance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskgrid.config import DEFAULT, TASK_TYPES, TaskConfig

RECORD = "__record"  # a whole record with another number of fields than the header


def _reader(spark: SparkSession, multi_line: bool):
    # every value is read as text so that NA tokens can be recognised before any
    # cast; a quote inside quotes is doubled, a backslash is an ordinary character
    return (spark.read.option("header", True).option("inferSchema", False)
                 .option("quote", '"').option("escape", '"').option("enforceSchema", False)
                 .option("multiLine", multi_line))


def _raw_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False,
             checked: bool = False) -> DataFrame:
    """All columns as text. A record with another number of fields raises, or with ``checked`` goes to column RECORD."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = _reader(spark, multi_line)
    if not checked:
        return read.option("mode", "FAILFAST").csv(paths)
    names = read.csv(paths).columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, RECORD])
    # all fields are parsed whatever columns a query needs, so a record's verdict does not depend on the query
    return (read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
                .option("columnPruning", False).schema(ddl).csv(paths))


# -- values -----------------------------------------------------------------------
def _named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _given(c: Column, cfg: TaskConfig) -> Column:
    """The text of a value; null for an NA token."""
    return F.when(c.isin(list(cfg.na_tokens)), F.lit(None).cast("string")).otherwise(c)


def _typed(c: Column, kind: str) -> Column:
    if kind in ("bigint", "int"):  # 12.0 is a whole number
        d = c.try_cast("decimal(38,10)")
        return F.coalesce(c.try_cast(kind), F.when(d == F.floor(d), d.try_cast(kind)))
    return c if kind == "string" else c.try_cast(kind)


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def normalise(df: DataFrame, cfg: TaskConfig = DEFAULT, types: Mapping[str, str] | None = TASK_TYPES,
              bad_values: str = "null") -> DataFrame:
    """NA tokens to null in every text column, then cast columns named in ``types``.

    A value that does not parse becomes null, or raises with ``bad_values="fail"``
    (``read_checked`` lists such values). ZIP codes stay text so leading zeros survive.
    """
    if bad_values not in ("null", "fail"):
        raise ValueError(f"bad_values is 'null' or 'fail', not {bad_values!r}")
    types, text, cols = dict(types or {}), set(_text_columns(df)), []
    for name in df.columns:
        c = _named(name)
        if name in text:
            given = _given(c, cfg)
            c = _typed(given, types.get(name, "string"))
            if bad_values == "fail" and types.get(name, "string") != "string":
                c = F.coalesce(c, F.when(given.isNotNull(), F.raise_error(F.concat(
                    F.lit(f"column {name}: not a {types[name]}: "), given)).cast(types[name])))
        cols.append(c.alias(name))
    return df.select(*cols)


def rejects(raw: DataFrame, cfg: TaskConfig = DEFAULT, types: Mapping[str, str] | None = TASK_TYPES) -> DataFrame:
    """(file, column_name, value, reason) for each value of ``raw`` that does not parse as its column's type, and each
    record with another number of fields (no column name, the record as value)."""
    found = []
    for name, kind in dict(types or {}).items():
        if name in raw.columns and kind != "string":
            given = _given(_named(name), cfg)
            found.append(F.when(given.isNotNull() & _typed(given, kind).isNull(), F.struct(
                F.lit(name).alias("column_name"), given.alias("value"), F.lit(f"not a {kind}").alias("reason"))))
    if RECORD in raw.columns:
        # a reader refuses queries of the record column alone, so a first field is always asked for
        first = F.length(F.coalesce(_named(raw.columns[0]), F.lit(""))) >= 0
        found.append(F.when(first & F.col(RECORD).isNotNull(), F.struct(
            F.lit(None).cast("string").alias("column_name"), F.col(RECORD).alias("value"),
            F.lit("wrong number of fields").alias("reason"))))
    if not found:
        return raw.select(F.lit("").alias("file"), F.lit("").alias("column_name"), F.lit("").alias("value"),
                          F.lit("").alias("reason")).limit(0)
    listed = raw.select(F.col("_metadata.file_path").alias("file"), F.array(*found).alias("x"))
    return listed.select("file", F.explode(F.filter("x", lambda x: x.isNotNull())).alias("x")).select("file", "x.*")


# -- type inference -----------------------------------------------------------------
# Narrowest first. A value fits ``bigint`` only if it fits ``double``, and ``date`` only if it fits
# ``timestamp``; a type fits a column if it fits all its values, so the counts of values that fit add up over files.
LATTICE = ("boolean", "bigint", "double", "date", "timestamp")
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")
NUMBER = r"^[+-]?(0|[1-9][0-9]*)"  # 007 is a label, not a number


def _fits(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c.isin(*BOOLEANS)
    if kind == "bigint":
        return c.rlike(NUMBER + "$") & c.try_cast("bigint").isNotNull()
    if kind == "double":
        return c.rlike(r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$") & c.try_cast("double").isNotNull()
    if kind == "date":
        return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull()
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$") & \
        c.try_cast("timestamp").isNotNull()


def type_counts(df: DataFrame, columns: Sequence[str] | None = None, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """One row: per text column a struct of its non-NA values and how many of them fit each type of the lattice."""
    out = []
    for name in columns if columns is not None else _text_columns(df):
        c = _given(_named(name), cfg)
        out.append(F.struct(F.count(c).alias("values"), *[F.count_if(_fits(c, k)).alias(k) for k in LATTICE]).alias(name))
    return df.agg(*out) if out else df.limit(0).agg(F.count(F.lit(1)).alias("rows")).select()


def merged_type(x: Column) -> Column:
    """The narrowest type that all values of a struct of ``type_counts`` fit; text without a value."""
    picked = F.when(x["values"] == 0, "string")
    for k in LATTICE:
        picked = picked.when(x[k] == x["values"], k)
    return picked.otherwise("string")


def inferred_types(df: DataFrame, columns: Sequence[str] | None = None, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """(column_name, type, values) of the text columns of ``df``, from one aggregate over all its rows."""
    names = list(columns if columns is not None else _text_columns(df))
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, type string, values bigint")
    counts = type_counts(df, names, cfg)
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("column_name"), merged_type(_named(n)).alias("type"), _named(n)["values"].alias("values"))
        for n in names])))


def _all_types(df: DataFrame, cfg: TaskConfig, types: Mapping[str, str] | None, infer: bool) -> dict[str, str]:
    """``types``, and with ``infer`` the inferred types of the other text columns (one row per column is fetched)."""
    types = dict(types or {})
    if infer:
        others = [n for n in _text_columns(df) if n not in types and n != RECORD]
        types |= {r.column_name: r.type for r in inferred_types(df, others, cfg).collect()}
    return types


# -- readers ------------------------------------------------------------------------
@dataclass(frozen=True)
class Reading:
    """``rows``: the typed task list; ``rejects``: file, column_name, value, reason of all that did not parse."""
    rows: DataFrame
    rejects: DataFrame


def read_tasks_csv(spark: SparkSession, paths: str | Sequence[str], cfg: TaskConfig = DEFAULT,
                   types: Mapping[str, str] | None = TASK_TYPES, multi_line: bool = False,
                   infer: bool = False, bad_values: str = "null") -> DataFrame:
    """CSV files sharing one header → typed task list.

    A file whose header differs, or a record with another number of fields,
    raises. ``multi_line`` reads line breaks inside quotes; each file is then
    one task, so it is off by default, and such a record raises. ``infer`` also
    types the columns that ``types`` does not name. ``bad_values="fail"`` raises
    where a value does not parse; ``read_checked`` lists those values instead."""
    raw = _raw_csv(spark, paths, multi_line)
    return normalise(raw, cfg, _all_types(raw, cfg, types, infer), bad_values)


def read_checked(spark: SparkSession, paths: str | Sequence[str], cfg: TaskConfig = DEFAULT,
                 types: Mapping[str, str] | None = TASK_TYPES, multi_line: bool = False,
                 infer: bool = False) -> Reading:
    """S1 with a second result that lists every value and record that did not parse.

    A record with too few or too many fields keeps the fields that are there."""
    raw = _raw_csv(spark, paths, multi_line, checked=True)
    types = _all_types(raw, cfg, types, infer)
    return Reading(normalise(raw.drop(RECORD), cfg, types), rejects(raw, cfg, types))


def _sheets(spark: SparkSession, paths: Sequence[str], multi_line: bool, checked: bool = False) -> list[DataFrame]:
    """One scan per distinct header, in order of first appearance."""
    if not paths:
        raise ValueError("no sheets to read")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        by_header.setdefault(tuple(_reader(spark, multi_line).csv(p).columns), []).append(p)
    return [_raw_csv(spark, same, multi_line, checked) for same in by_header.values()]


def _by_name(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_sheets(spark: SparkSession, paths: Sequence[str], cfg: TaskConfig = DEFAULT,
                 types: Mapping[str, str] | None = TASK_TYPES, multi_line: bool = False,
                 infer: bool = False, bad_values: str = "null") -> DataFrame:
    """Files with different headers, concatenated by column name.

    Each path is one sheet (a file or a folder of files with one header).
    Sheets of one header are one scan. With ``infer`` a column's type is the
    narrowest one that its values of all sheets fit.
    """
    merged = _by_name(_sheets(spark, paths, multi_line))
    return normalise(merged, cfg, _all_types(merged, cfg, types, infer), bad_values)


def union_sheets_checked(spark: SparkSession, paths: Sequence[str], cfg: TaskConfig = DEFAULT,
                         types: Mapping[str, str] | None = TASK_TYPES, multi_line: bool = False,
                         infer: bool = False) -> Reading:
    """S2 with the list of what did not parse, over all sheets."""
    sheets = _sheets(spark, paths, multi_line, checked=True)
    merged = _by_name([s.drop(RECORD) for s in sheets])
    types = _all_types(merged, cfg, types, infer)
    return Reading(normalise(merged, cfg, types), reduce(DataFrame.unionByName, [rejects(s, cfg, types) for s in sheets]))
