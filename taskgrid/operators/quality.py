"""Analyser: data-quality profile of a task list.

Every result is a DataFrame; one-number results are one-row DataFrames.
Grouped outputs drop the null retailer (pandas drops null group keys);
scalar totals count every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskgrid.config import DEFAULT, TOTAL_LABEL, TaskConfig
from taskgrid.functions.nullsafe import equals, is_in, not_in, pct
from taskgrid.operators.joins import repeated_keys, semi_on_pairs




def _one() -> Column:
    return F.lit(1)


def _n() -> Column:
    return F.count(F.lit(1))


# -- counts -------------------------------------------------------------------
def total_records(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A1: row count."""
    return df.agg(_n().alias("total_records"))


def unique_retailers(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A2: distinct retailer names, null included."""
    return df.select(cfg.list_name).distinct()


def unique_retailers_count(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A3: number of distinct non-null retailer names."""
    return df.agg(F.count_distinct(cfg.list_name).alias("unique_retailers_count"))


def records_per_retailer(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A4: rows per retailer, most first (ties by name)."""
    return (df.filter(F.col(cfg.list_name).isNotNull())
              .groupBy(cfg.list_name).agg(_n().alias("record_count"))
              .orderBy(F.desc("record_count"), F.asc(cfg.list_name)))


# -- pivots -------------------------------------------------------------------
def _discover(df: DataFrame, value: Column) -> list[str]:
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    rows = df.select(value.alias("v")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct pivot values")
    return sorted(r["v"] for r in rows)


def _breakdown(df: DataFrame, cfg: TaskConfig, column: str, fill: str,
               values: Sequence[str] | None) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(fill))
    rows = df.filter(F.col(cfg.list_name).isNotNull())
    if values is None:
        values = _discover(rows, value)
    values = list(values)
    if TOTAL_LABEL in values or cfg.list_name in values:
        raise ValueError(f"a pivot value collides with an output column: {values}")
    # One aggregate with a conditional count per label: a single exchange with
    # map-side partial aggregation, instead of pivot's two aggregates.
    wide = rows.groupBy(cfg.list_name).agg(
        *[F.count_if(value == v).alias(v) for v in values], _n().alias(TOTAL_LABEL))
    listed = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    # a filter, unlike a column, is never pruned
    fault = F.raise_error(F.lit(f"{column} holds labels beyond the listed columns; use the long form"))
    return wide.filter(F.when(listed == F.col(TOTAL_LABEL), True).otherwise(fault.cast("boolean")))


def _long(df: DataFrame, cfg: TaskConfig, column: str, fill: str) -> DataFrame:
    return (df.filter(F.col(cfg.list_name).isNotNull())
              .groupBy(cfg.list_name, F.coalesce(F.col(column), F.lit(fill)).alias("label"))
              .agg(_n().alias("n")))


def construction_flag_long(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A5 in long form: (retailer, label, n) for every label that occurs."""
    return _long(df, cfg, cfg.construction_flag, cfg.flag_normal)


def polygon_status_long(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A6 in long form: (retailer, label, n) for every label that occurs."""
    return _long(df, cfg, cfg.polygon_status, cfg.flag_normal)


def construction_flag_breakdown(df: DataFrame, cfg: TaskConfig = DEFAULT,
                                values: Sequence[str] | None = None) -> DataFrame:
    """A5: retailer × flag counts (null flag counted as Normal) plus Total.

    ``values`` fixes the label columns; without it they are discovered. A
    label outside ``values`` fails the query, so no count is lost unseen.
    ``Total`` is the retailer's row count.
    """
    return _breakdown(df, cfg, cfg.construction_flag, cfg.flag_normal, values)


def polygon_status_breakdown(df: DataFrame, cfg: TaskConfig = DEFAULT,
                             values: Sequence[str] | None = None) -> DataFrame:
    """Retailer × status counts; a null status is labelled Normal too."""
    return _breakdown(df, cfg, cfg.polygon_status, cfg.flag_normal, values)


# -- duplicates -----------------------------------------------------------------
def _dup_aggs(cfg: TaskConfig) -> list[Column]:
    has_null = F.when(_n() > F.count(cfg.ali), 1).otherwise(0)
    distinct = F.count_distinct(cfg.ali)
    return [distinct.alias("unique_ali"),
            (_n() - distinct - has_null).alias("duplicate_count")]


def duplicate_ali_summary(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Total rows, distinct non-null ALIs, surplus duplicates (null is one value)."""
    return df.agg(_n().alias("total"), *_dup_aggs(cfg))


def duplicate_ali_rows(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Every row whose ALI occurs more than once (nulls equal each other).

    A count per key (partially aggregated, so a hot key costs one row per
    task) semi-joined back, rather than a window that would put every row of
    a hot key into one task.
    """
    return semi_on_pairs(df, cfg.ali, repeated_keys(df, cfg.ali))


# -- percentages ----------------------------------------------------------------
def _stack(agg_row: DataFrame, items: list[tuple[str, str]], total: str) -> DataFrame:
    arr = F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).alias("count"),
                 pct(F.col(c), F.col(total)).alias("pct"))
        for label, c in items])
    return agg_row.select(F.inline(arr))


def _flag_counts(cfg: TaskConfig) -> dict[str, Column]:
    f = F.coalesce(F.col(cfg.construction_flag), F.lit(cfg.flag_normal))
    return {"construction": F.count_if(f == cfg.flag_construction),
            "mall_tenant": F.count_if(f == cfg.flag_mall_tenant),
            "multi_level": F.count_if(f == cfg.flag_multi_level),
            "normal": F.count_if(f == cfg.flag_normal)}


def _named(counts: dict[str, Column]) -> list[Column]:
    return [c.alias(f"{k}_count") for k, c in counts.items()]


def construction_flag_percentages(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Count and % of the four flag labels (null counted as Normal)."""
    row = df.agg(_n().alias("_t"), *_named(_flag_counts(cfg)))
    return _stack(row, [("Construction", "construction_count"),
                        ("Mall Tenant", "mall_tenant_count"),
                        ("Multi Level", "multi_level_count"),
                        ("Normal", "normal_count")], "_t")


def _status_counts(cfg: TaskConfig) -> dict[str, Column]:
    verified = F.count_if(equals(F.col(cfg.polygon_status), cfg.status_verified_qa))
    return {"verified_qa": verified, "unverified": _n() - verified}


def polygon_status_percentages(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A10: VerifiedQA versus everything else."""
    row = df.agg(_n().alias("_t"), *_named(_status_counts(cfg)))
    return _stack(row, [("Verified QA", "verified_qa_count"),
                        ("Unverified", "unverified_count")], "_t")


def _parent_counts(cfg: TaskConfig) -> dict[str, Column]:
    connected = F.count(cfg.parent_ali)
    return {"connected": connected, "unknown": _n() - connected}


def parent_ali_percentages(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Parent key present versus missing."""
    row = df.agg(_n().alias("_t"), *_named(_parent_counts(cfg)))
    return _stack(row, [("connected", "connected_count"), ("unknown", "unknown_count")], "_t")


def parent_ali_per_retailer(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Retailer × Connected/Unknown counts plus Total."""
    connected = F.count(cfg.parent_ali)
    return (df.filter(F.col(cfg.list_name).isNotNull()).groupBy(cfg.list_name)
              .agg(connected.alias("Connected"), (_n() - connected).alias("Unknown"),
                   _n().alias(TOTAL_LABEL)))


# -- QC rules -------------------------------------------------------------------
def _mall_tenant_error(cfg: TaskConfig) -> Column:
    return same_flag(cfg, cfg.flag_mall_tenant) & F.col(cfg.polygon_status).isNotNull()


def _multi_level_error(cfg: TaskConfig) -> Column:
    return same_flag(cfg, cfg.flag_multi_level) & F.col(cfg.polygon_status).isNotNull()


def _construction_error(cfg: TaskConfig) -> Column:
    return same_flag(cfg, cfg.flag_construction) & (
        F.col(cfg.polygon_status).isNotNull() | is_in(F.col(cfg.geo_accuracy), cfg.geo_verified))


def same_flag(cfg: TaskConfig, label: str) -> Column:
    """Raw flag equals ``label`` (a null flag equals nothing)."""
    return equals(F.col(cfg.construction_flag), label)


def qc_mall_tenant_errors(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Mall Tenant rows that carry a polygon status."""
    return df.filter(_mall_tenant_error(cfg))


def qc_multi_level_errors(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Multi-Level rows that carry a polygon status."""
    return df.filter(_multi_level_error(cfg))


def qc_construction_errors(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Construction rows with a status or a verified-rooftop geo accuracy."""
    return df.filter(_construction_error(cfg))


def _qc_counts(cfg: TaskConfig) -> list[Column]:
    mt = F.count_if(_mall_tenant_error(cfg))
    ml = F.count_if(_multi_level_error(cfg))
    co = F.count_if(_construction_error(cfg))
    return [mt.alias("mall_tenant_errors"), ml.alias("multi_level_errors"),
            co.alias("construction_errors"), (mt + ml + co).alias("total_errors")]


def qc_error_totals(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Error count per rule and in total (a row may count under one rule only)."""
    return df.agg(*_qc_counts(cfg))


# -- coverage -------------------------------------------------------------------
def marked_condition(cfg: TaskConfig = DEFAULT) -> Column:
    s = F.coalesce(F.col(cfg.polygon_status), F.lit(cfg.status_none))
    f = F.coalesce(F.col(cfg.construction_flag), F.lit(cfg.flag_normal))
    g = is_in(F.col(cfg.geo_accuracy), cfg.geo_verified)
    open_status = s.isin(cfg.status_none, cfg.status_draft)
    return (s.isin(cfg.status_verified_qa, cfg.status_verified_admin)
            | f.isin(cfg.flag_mall_tenant, cfg.flag_multi_level)
            | (open_status & (f == cfg.flag_normal) & g))


def pending_condition(cfg: TaskConfig = DEFAULT) -> Column:
    s = F.coalesce(F.col(cfg.polygon_status), F.lit(cfg.status_none))
    f = F.coalesce(F.col(cfg.construction_flag), F.lit(cfg.flag_normal))
    g = is_in(F.col(cfg.geo_accuracy), cfg.geo_verified)
    return s.isin(cfg.status_none, cfg.status_draft) & (
        (f == cfg.flag_construction) | ((f == cfg.flag_normal) & ~g))


def classify_marked(df: DataFrame, cfg: TaskConfig = DEFAULT,
                    column: str = "coverage") -> DataFrame:
    """Label each row ``marked``, ``pending`` or ``neither``.

    The two conditions never overlap and do not cover every row (e.g. a
    Rejected status, or an unknown flag, is neither).
    """
    return df.withColumn(column, F.when(marked_condition(cfg), "marked")
                         .when(pending_condition(cfg), "pending").otherwise("neither"))


def _coverage_counts(cfg: TaskConfig) -> list[Column]:
    marked = F.count_if(marked_condition(cfg))
    pending = F.count_if(pending_condition(cfg))
    done = F.count_if(is_in(F.col(cfg.polygon_status),
                            (cfg.status_verified_qa, cfg.status_verified_admin)))
    return [marked.alias("marked_count"), pct(marked, _n()).alias("marked_pct"),
            pending.alias("pending_count"), pct(pending, _n()).alias("pending_pct"),
            done.alias("polygon_done_count"), pending.alias("polygon_missing_count")]


def polygon_coverage(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Marked / pending counts and shares, done, missing, flag counts."""
    flags = _flag_counts(cfg)
    return df.agg(_n().alias("total"), *_coverage_counts(cfg),
                  *_named({k: flags[k] for k in ("mall_tenant", "multi_level", "construction")}))


def full_analysis_row(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A19 (scalar part): every one-number result in one aggregate.

    One scan and one aggregate: the two distinct counts (retailers, ALIs) and
    all conditional counts are planned together, partially aggregated per
    task before the exchange.
    """
    n = _n()
    cols = [n.alias("total_records"),
            F.count_distinct(cfg.list_name).alias("unique_retailers_count"),
            *_dup_aggs(cfg)]
    counts = {**_flag_counts(cfg), **_status_counts(cfg), **_parent_counts(cfg)}
    for k, c in counts.items():
        cols += [c.alias(f"{k}_count"), pct(c, n).alias(f"{k}_pct")]
    cols += _qc_counts(cfg) + _coverage_counts(cfg)
    return df.agg(*cols)


# -- launch ---------------------------------------------------------------------
def needs_work_condition(cfg: TaskConfig = DEFAULT) -> Column:
    """Geo accuracy is not a verified-rooftop value (null included)."""
    return not_in(F.col(cfg.geo_accuracy), cfg.geo_verified)


def needs_work(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Rows that still need launching."""
    return df.filter(needs_work_condition(cfg))


def needs_work_preview(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Per retailer, rows needing work (zeros kept), most first."""
    return (df.filter(F.col(cfg.list_name).isNotNull()).groupBy(cfg.list_name)
              .agg(F.count_if(needs_work_condition(cfg)).alias("needs_work_count"))
              .orderBy(F.desc("needs_work_count"), F.asc(cfg.list_name)))


def launch_subset(df: DataFrame, cfg: TaskConfig = DEFAULT,
                  selected: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Needs-work rows of the selected retailers (``None`` = all).

    A short list becomes an ``IN`` filter (pushed to the scan); a longer list, of
    any length, or a DataFrame of names a semi join whose strategy Spark picks
    from its size. The names are not made distinct first (a semi join needs no
    distinct side), so both sides are plain exchanges and AQE can split a hot
    retailer.
    """
    rows = needs_work(df, cfg)
    if selected is None:
        return rows
    if isinstance(selected, DataFrame):
        names = selected.select(F.col(selected.columns[0]).alias("_sel"))
        return rows.join(names, F.col(cfg.list_name) == names["_sel"], "left_semi")
    selected = list(dict.fromkeys(selected))
    if len(selected) <= 1000:
        return rows.filter(F.col(cfg.list_name).isin(selected))
    names = df.sparkSession.createDataFrame([(s,) for s in selected], "_sel string")
    return rows.join(names, F.col(cfg.list_name) == names["_sel"], "left_semi")


def launch_summary(rows: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Mode (null without rows) and total of a launch subset, one row. The per-retailer counts
    are ``records_per_retailer(rows)``: a table, not a map in one row."""
    return rows.agg(
        F.when(_n() == 0, F.lit(None).cast("string")).when(F.count_distinct(cfg.list_name) == 1, "single")
         .otherwise("multi").alias("mode"),
        _n().alias("total_alis"),
        F.count_distinct(cfg.list_name).alias("retailers"))


PROFILE_SECTIONS = ("records", "construction_flag", "polygon_status", "parent_ali", "needs_work")


def grouped_profile(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A19 (grouped part): every per-retailer output in one pass, long form (section, retailer, label, n).

    Sections are A4 (``records``, label null), A5, A6, A12 (labels Connected, Unknown) and A21 (labels yes, no; a
    retailer without rows of a label has no row of it). GROUPING SETS expand a row to one per section before the
    partial aggregate, so what is shuffled is one row per retailer, label and task."""
    name = F.col(cfg.list_name)
    rows = df.filter(name.isNotNull()).select(
        name.alias("_r"),
        F.coalesce(F.col(cfg.construction_flag), F.lit(cfg.flag_normal)).alias("_flag"),
        F.coalesce(F.col(cfg.polygon_status), F.lit(cfg.flag_normal)).alias("_status"),
        F.when(F.col(cfg.parent_ali).isNotNull(), "Connected").otherwise("Unknown").alias("_parent"),
        F.when(needs_work_condition(cfg), "yes").otherwise("no").alias("_needs"))
    labels = ("_flag", "_status", "_parent", "_needs")
    sets = [["_r"], *[["_r", c] for c in labels]]
    told = rows.groupingSets(sets, "_r", *labels).agg(_n().alias("n"), F.grouping_id().alias("_id"))
    section = F.lit(PROFILE_SECTIONS[0])
    for k, s in enumerate(PROFILE_SECTIONS[1:]):
        # grouping_id has a 1 for each column that a set leaves out; the label columns are the last four bits
        section = F.when(F.col("_id") == 15 - (8 >> k), s).otherwise(section)
    return told.select(section.alias("section"), F.col("_r").alias(cfg.list_name),
                       F.coalesce(*labels).alias("label"), "n")


def coverage_by(df: DataFrame, keys: Sequence[str], cfg: TaskConfig = DEFAULT) -> DataFrame:
    """A18 per group: the coverage counts for each value of ``keys``."""
    flags = _flag_counts(cfg)
    return df.groupBy(*keys).agg(
        _n().alias("total"), *_coverage_counts(cfg),
        *_named({k: flags[k] for k in ("mall_tenant", "multi_level", "construction")}))


def retailer_profile(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Long-form per-retailer counts: one row per (retailer, flag label,
    status label, parent present, needs work). Every per-retailer output
    (A4, A5, A6, A12, A21) is a small aggregate of this table, so one scan
    of the data serves all of them. Null retailers are dropped."""
    return (df.filter(F.col(cfg.list_name).isNotNull())
              .groupBy(F.col(cfg.list_name).alias(cfg.list_name),
                       F.coalesce(F.col(cfg.construction_flag), F.lit(cfg.flag_normal)).alias("_flag"),
                       F.coalesce(F.col(cfg.polygon_status), F.lit(cfg.flag_normal)).alias("_status"),
                       F.col(cfg.parent_ali).isNotNull().alias("_parent"),
                       needs_work_condition(cfg).alias("_needs"))
              .agg(_n().alias("_c")))


def from_profile(profile: DataFrame, cfg: TaskConfig = DEFAULT,
                 flag_values: Sequence[str] | None = None,
                 status_values: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """A4, A5, A6, A12, A21 computed from ``retailer_profile`` output."""
    ln = cfg.list_name

    def pivot(col: str, values) -> DataFrame:
        values = list(_discover(profile, F.col(col)) if values is None else values)
        if TOTAL_LABEL in values or ln in values:
            raise ValueError(f"a pivot value collides with an output column: {values}")
        return profile.groupBy(ln).agg(
            *[F.coalesce(F.sum(F.when(F.col(col) == v, F.col("_c"))), F.lit(0)).alias(v) for v in values],
            F.sum("_c").alias(TOTAL_LABEL))

    return {
        "per_retailer": profile.groupBy(ln).agg(F.sum("_c").alias("record_count"))
                               .orderBy(F.desc("record_count"), F.asc(ln)),
        "construction_flag": pivot("_flag", flag_values),
        "polygon_status": pivot("_status", status_values),
        "parent_per_retailer": profile.groupBy(ln).agg(
            F.sum(F.when(F.col("_parent"), F.col("_c")).otherwise(0)).alias("Connected"),
            F.sum(F.when(~F.col("_parent"), F.col("_c")).otherwise(0)).alias("Unknown"),
            F.sum("_c").alias(TOTAL_LABEL)),
        "needs_work_preview": profile.groupBy(ln).agg(
            F.sum(F.when(F.col("_needs"), F.col("_c")).otherwise(0)).alias("needs_work_count"))
                                     .orderBy(F.desc("needs_work_count"), F.asc(ln)),
    }
