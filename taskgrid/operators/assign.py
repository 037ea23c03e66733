"""Task launcher: divide rows among analysts.

Assignments are one DataFrame with an ``analyst`` column (the source tool
keeps a dict of per-analyst frames). Random splits are seeded and
reproducible: the shuffle order is the row hash (see ``slicing``).
Plans are small tables: ``plan (list_name, target)`` where target is an
analyst or ``Split``, and ``split_plan (list_name, analyst, n)``; plain
dicts are accepted too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskgrid.config import (
    ANALYST_FILL, DEFAULT, DISPLAY_NAMES, LAUNCHER_LAYOUT, SPLIT, TOTAL_LABEL, TaskConfig,
)
from taskgrid.functions.nullsafe import pct
from taskgrid.operators import slicing
from taskgrid.session import scratch_path


def _names(analysts: Sequence[str]) -> list[str]:
    names = list(analysts)
    if not names:
        raise ValueError("at least one analyst is needed")
    if len(set(names)) != len(names):
        raise ValueError(f"analyst names must be unique: {names}")
    return names


def analysts_frame(spark: SparkSession, analysts: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_names(analysts))), "position int, analyst string")


# -- T1, T2 ---------------------------------------------------------------------
def retailer_mode(df: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """``single`` iff exactly one distinct non-null retailer, else ``multi``."""
    n = F.count_distinct(cfg.list_name)
    return df.agg(F.when(n == 1, "single").otherwise("multi").alias("mode"), n.alias("retailers"))


def split_target(df: DataFrame, n_analysts: int) -> DataFrame:
    """``target = total div n`` and ``remainder = total % n``."""
    if n_analysts <= 0:
        raise ValueError("the number of analysts must be positive")
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.lit(n_analysts).alias("analysts"),
                  F.floor(n / n_analysts).cast("bigint").alias("target"),
                  (n % n_analysts).alias("remainder"))


# -- T3 -------------------------------------------------------------------------
def equal_split(df: DataFrame, analysts: Sequence[str], seed: int | str = 0,
                digits: int | None = None) -> DataFrame:
    """Seeded shuffle cut into ``len(analysts)`` slices of ``total div n``
    rows; the first analyst also takes the whole remainder.

    ``digits`` (hash-prefix buckets, see ``slicing``) defaults to a value
    derived from the row count, read by a scalar subquery of the same query."""
    names = _names(analysts)
    cols = df.columns
    total = df.agg(F.count(F.lit(1))).scalar()
    x, bc = slicing.bucket_counts(df, None, seed, slicing.auto_digits(total) if digits is None else digits)
    k = len(names)
    target, rem = F.floor(total / k).cast("bigint"), (total % k).cast("bigint")
    # the same empty group as the buckets', again not as a literal
    slices = (df.sparkSession.range(k).select(
        F.substring(F.col("id").cast("string"), 1, 0).alias("_g"), F.col("id"),
        F.element_at(F.array(*[F.lit(a) for a in names]), (F.col("id") + 1).cast("int")).alias("analyst"))
        .select("_g", "analyst", F.when(F.col("id") == 0, F.lit(0)).otherwise(rem + F.col("id") * target)
                .cast("bigint").alias("lo"), (rem + (F.col("id") + 1) * target).cast("bigint").alias("hi")))
    # the map has one row per bucket, about sqrt(rows) of them and 16**6 at most
    return slicing.assign_ranges(x, bc, slices, cols, bounded=digits is None)


# -- plans ----------------------------------------------------------------------
def plan_frame(spark: SparkSession, plan: Mapping[str, str] | DataFrame) -> DataFrame:
    if isinstance(plan, DataFrame):
        return plan.select("list_name", "target")
    return spark.createDataFrame(list(plan.items()), "list_name string, target string")


def split_frame(spark: SparkSession, split_plan: Mapping[str, Mapping[str, int]] | DataFrame | None,
                analysts: Sequence[str]) -> DataFrame:
    """``(list_name, analyst, n, seq)``; ``seq`` orders the slices of a retailer
    (dict order, else the analyst's position in the list)."""
    if split_plan is None:
        split_plan = {}
    if isinstance(split_plan, DataFrame):
        if "seq" in split_plan.columns:
            return split_plan.select("list_name", "analyst", F.col("n").cast("bigint").alias("n"),
                                     F.col("seq").cast("int").alias("seq"))
        order = F.create_map(*[x for i, a in enumerate(analysts) for x in (F.lit(a), F.lit(i))])
        return split_plan.select("list_name", "analyst", F.col("n").cast("bigint").alias("n"),
                                 F.coalesce(order[F.col("analyst")], F.lit(len(analysts))).alias("seq"))
    rows = [(r, a, int(n), i) for r, m in split_plan.items() for i, (a, n) in enumerate(m.items())]
    return spark.createDataFrame(rows, "list_name string, analyst string, n bigint, seq int")


def plan_entries(df: DataFrame, names: list[str], plan, split_plan) -> DataFrame:
    """The plan as one table: list_name, target, times (rows of the plan that name the retailer), and for each share of
    a Split retailer analyst, n, seq. Without a plan every retailer of ``split_plan`` is Split.

    Given as tables, the plans may come from long queries: the entries are written once to the shared scratch folder
    and read again by the checks and by each use."""
    spark = df.sparkSession
    sp = split_frame(spark, split_plan, names)
    if plan is None:
        p = sp.select("list_name").distinct().select("list_name", F.lit(SPLIT).alias("target"), F.lit(1).alias("times"))
    else:
        p = plan_frame(spark, plan).groupBy("list_name").agg(
            F.min("target").alias("target"), F.count(F.lit(1)).cast("int").alias("times"))
    entries = p.join(sp.withColumn("_t", F.lit(SPLIT)), (p.list_name == sp.list_name) & (F.col("target") == F.col("_t")),
                     "left").select(p.list_name, "target", "times", "analyst", "n", "seq")
    if not isinstance(plan, DataFrame) and not isinstance(split_plan, DataFrame):
        return entries
    path = scratch_path(spark, "plan-entries")
    entries.write.parquet(path)
    return spark.read.parquet(path)


MAP_ROWS = 200_000  # planned retailers and buckets of their split that are broadcast


def _sliced(df: DataFrame, entries: DataFrame, names: list[str], seed: int | str, cfg: TaskConfig,
            digits: int | None = None) -> DataFrame:
    """Rows of the planned retailers with their analyst: whole retailers as one slice, Split ones cut by their counts."""
    w = Window.partitionBy("list_name")
    upto = w.orderBy("seq", "analyst").rowsBetween(Window.unboundedPreceding, 0)
    shares = entries.filter((F.col("target") == SPLIT) & F.col("n").isNotNull()).select(
        "list_name", "analyst", "n", F.sum("n").over(upto).alias("hi"), F.sum("n").over(w).alias("total"))
    length = slicing.auto_digits(F.col("total")) if digits is None else F.lit(digits)
    groups = shares.select("list_name", length.alias("_digits"), F.lit(None).cast("string").alias("_whole")).distinct()
    whole = entries.filter(F.col("target").isin(names) & (F.col("target") != SPLIT)).select(
        "list_name", F.lit(0).alias("_digits"), F.col("target").alias("_whole"))
    groups = groups.unionByName(whole).withColumnRenamed("list_name", "_rn")
    # the plan bounds the bucket map: a retailer has no more buckets than its prefix length allows, or than it has rows
    most = shares.select("list_name", F.least(F.pow(F.lit(16.0), length), F.col("total").cast("double")).alias("b")).distinct()
    bounded = slicing.broadcasts(df) and most.select("b").unionAll(whole.select(F.lit(1.0).alias("b"))).agg(
        F.coalesce(F.sum("b"), F.lit(0.0)) <= MAP_ROWS).first()[0]
    rows = df.join(F.broadcast(groups) if bounded else groups, F.col(cfg.list_name) == F.col("_rn")).drop("_rn")
    x = slicing.with_buckets(rows, F.col(cfg.list_name), F.col("_digits"), df.columns, seed, fixed=F.col("_whole"))
    slices = shares.select(F.col("list_name").alias("_g"), "analyst", (F.col("hi") - F.col("n")).alias("lo"), "hi")
    bc = slicing.ranged(x.filter(F.col("_whole").isNull()))
    return slicing.assign_ranges(x, bc, slices, df.columns, fixed="_whole", bounded=bounded)


def split_by_counts(df: DataFrame, split_plan, analysts: Sequence[str], seed: int | str = 0,
                    cfg: TaskConfig = DEFAULT, digits: int | None = None, validate: bool = True) -> DataFrame:
    """T4 for every retailer in ``split_plan`` in one pass: rank each
    retailer's rows by hash and cut them by the given counts, in ``seq``
    order. The counts of a retailer must add up to its row count."""
    names = _names(analysts)
    entries = plan_entries(df, names, None, split_plan)
    if validate:
        _check_entries(df, entries, names, cfg)
    return _sliced(df, entries, names, seed, cfg, digits)


def _check_entries(df: DataFrame, entries: DataFrame, names: list[str], cfg: TaskConfig) -> None:
    """One job checks the plan: no retailer is planned twice, every Split retailer has counts, they name listed
    analysts only, and they add up to its row count (which reads the retailer column alone). At most 20 offending
    retailers reach the driver."""
    want = entries.groupBy("list_name").agg(
        F.min("target").alias("target"), F.max("times").alias("times"), F.sum("n").alias("requested"),
        F.array_sort(F.collect_set(F.when(~F.col("analyst").isin(names), F.col("analyst")))).alias("unknown"))
    want = want.filter((F.col("target") == SPLIT) | (F.col("times") > 1))
    have = (df.groupBy(F.col(cfg.list_name).alias("_name")).agg(F.count(F.lit(1)).alias("available"))
              .filter("_name is not null"))
    bad = ((F.col("times") > 1) | F.col("requested").isNull() | (F.size("unknown") > 0)
           | (F.col("requested") != F.col("available")))
    found = (want.join(have, F.col("list_name") == F.col("_name"), "left").na.fill(0, ["available"])
                 .filter(bad).orderBy(F.desc("times"), "list_name").limit(20).collect())
    for r in found:
        if r["times"] > 1:
            raise ValueError(f"retailer {r['list_name']!r} appears more than once in the plan")
    for r in found:
        if r["requested"] is None:
            raise ValueError(f"retailer {r['list_name']!r} is marked Split but has no counts")
    for r in found:
        if r["unknown"]:
            raise ValueError(f"split of retailer {r['list_name']!r} names analysts who are not "
                             f"listed: {list(r['unknown'])}")
    for r in found:
        raise ValueError(f"the counts of retailer {r['list_name']!r} sum to {r['requested']}, "
                         f"its rows to {r['available']}")


def fixed_count_split(df: DataFrame, retailer: str, split_counts: Mapping[str, int],
                      seed: int | str = 0, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """T4: split one retailer's rows by fixed counts (must sum exactly)."""
    return split_by_counts(df, {retailer: dict(split_counts)}, list(split_counts), seed, cfg)


def apply_plan(df: DataFrame, analysts: Sequence[str], plan, split_plan=None,
               seed: int | str = 0, cfg: TaskConfig = DEFAULT, validate: bool = True) -> DataFrame:
    """T5: whole retailers go to their analyst; ``Split`` retailers are cut by
    their counts. A retailer missing from the plan, or planned to an analyst
    who is not listed, is skipped; a Split retailer without counts, a split
    naming an unlisted analyst, or counts that do not add up, raise."""
    names = _names(analysts)
    entries = plan_entries(df, names, plan, split_plan)
    if validate:
        _check_entries(df, entries, names, cfg)
    return _sliced(df, entries, names, seed, cfg)


# -- T6–T8 ----------------------------------------------------------------------
def unassigned_count(df: DataFrame, assignments: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Distinct ALIs (null is a value) of ``df`` found in no assignment.

    One aggregate over both inputs tagged by origin (partial aggregation
    collapses hot keys), instead of distinct + anti join."""
    k = cfg.ali
    tagged = (df.select(F.col(k).alias("_k"), F.lit(0).alias("_a"))
                .unionByName(assignments.select(F.col(k).alias("_k"), F.lit(1).alias("_a"))))
    per = tagged.groupBy("_k").agg(F.max("_a").alias("_a"))
    return per.agg(F.count_if(F.col("_a") == 0).alias("unassigned_count"))


def assignment_retailers(assignments: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """T7 in long form: (analyst, retailer, n) for every retailer with rows at the analyst; a null retailer is left out."""
    return (assignments.filter(F.col(cfg.list_name).isNotNull())
            .groupBy("analyst", cfg.list_name).agg(F.count(F.lit(1)).alias("n")))


def summary_rows(counts: DataFrame, total: Column) -> DataFrame:
    """The summary's rows from one row per listed analyst (position, analyst, tasks_assigned, further columns):
    the count's share of ``total`` as ``"x%"``, and a ``Total`` row last."""
    more = [c for c in counts.columns if c not in ("position", "analyst", "tasks_assigned")]
    s = counts.withColumn("_total", total.cast("bigint")).withColumn("_last", F.max("position").over(Window.partitionBy()))
    share = F.coalesce(pct(F.col("tasks_assigned"), F.col("_total")), F.lit(0.0))
    row = F.struct("position", "analyst", "tasks_assigned", F.concat(share.cast("string"), F.lit("%")).alias("percentage"), *more)
    last = F.struct((F.col("_last") + 1).alias("position"), F.lit(TOTAL_LABEL).alias("analyst"),
                    F.col("_total").alias("tasks_assigned"), F.lit("100.0%").alias("percentage"),
                    *[F.lit("").alias(c) for c in more])
    rows = F.when(F.col("position") == 0, F.array(row, last)).otherwise(F.array(row))
    return s.select(F.inline(rows)).orderBy("position").drop("position")


def assignment_summary(assignments: DataFrame, analysts: Sequence[str], cfg: TaskConfig = DEFAULT,
                       retailer_list: bool = True) -> DataFrame:
    """Per analyst the row count, its share as ``"x%"`` and, with ``retailer_list``, the sorted retailer
    names in one text cell (``assignment_retailers`` has them as rows); analysts without rows are kept; a
    ``Total`` row last.

    Rows are counted per (analyst, retailer) first, so a retailer is one row per task before the exchange and the
    text is made of distinct names; the total is a window over one row per listed analyst."""
    names = analysts_frame(assignments.sparkSession, analysts)
    per = assignments.groupBy("analyst", cfg.list_name).agg(F.count(F.lit(1)).alias("n"))
    out = [F.sum("n").alias("tasks_assigned")]
    if retailer_list:
        out.append(F.array_join(F.sort_array(F.collect_list(cfg.list_name)), ", ").alias("assigned_retailers"))
    s = F.broadcast(names).join(per.groupBy("analyst").agg(*out), "analyst", "left").na.fill(
        {"tasks_assigned": 0} | ({"assigned_retailers": ""} if retailer_list else {}))
    return summary_rows(s, F.sum("tasks_assigned").over(Window.partitionBy()))


def analyst_sheets(assignments: DataFrame, cfg: TaskConfig = DEFAULT) -> DataFrame:
    """The 14-column analyst layout plus ``analyst``; fill columns and
    columns missing from the input are blank (``''``)."""
    by_display = {cfg.display(c): c for c in assignments.columns}
    by_display.update({DISPLAY_NAMES.get(c, c): c for c in assignments.columns})
    cols = []
    for name in LAUNCHER_LAYOUT:
        if name in ANALYST_FILL or name not in by_display:
            cols.append(F.lit("").alias(name))
        else:
            cols.append(F.col(by_display[name]).alias(name))
    return assignments.select(*cols, "analyst")


# -- T9–T11 (plan screen) -------------------------------------------------------
def assigned_counts(retailer_counts: DataFrame, analysts: Sequence[str], plan, split_plan=None,
                    cfg: TaskConfig = DEFAULT) -> DataFrame:
    """Rows each analyst would get from a plan: whole retailers' counts
    plus split shares. Analysts with nothing keep 0; unknown ones are ignored.
    ``retailer_counts`` is ``(list_name, record_count)`` as returned by
    ``records_per_retailer``."""
    spark = retailer_counts.sparkSession
    names = _names(analysts)
    p = plan_frame(spark, plan)
    sp = split_frame(spark, split_plan, names)
    rc = retailer_counts.select(F.col(cfg.list_name).alias("list_name"),
                                F.col("record_count").alias("cnt"))
    whole = (rc.join(p, "list_name").filter(F.col("target").isin(names))
               .select(F.col("target").alias("analyst"), F.col("cnt").alias("v")))
    split = (rc.join(p.filter(F.col("target") == SPLIT), "list_name").join(sp, "list_name")
               .filter(F.col("analyst").isin(names)).select("analyst", F.col("n").alias("v")))
    got = whole.unionByName(split).groupBy("analyst").agg(F.sum("v").alias("assigned"))
    return (F.broadcast(analysts_frame(spark, names)).join(got, "analyst", "left")
              .select("position", "analyst", F.coalesce("assigned", F.lit(0)).cast("bigint").alias("assigned"))
              .orderBy("position").drop("position"))


def balance_status(assigned: DataFrame, target) -> DataFrame:
    """Status of each analyst's count against the target:
    ``neutral`` (target ≤ 0), ``over``, ``onTarget``, ``near`` (≥ 85%),
    ``filling``; ``bar_pct`` is the fill share capped at 100.

    ``target`` is a number or the one-row result of ``split_target``."""
    if isinstance(target, DataFrame):
        target = target.select("target").first()["target"]
    t = F.lit(int(target)).cast("bigint")
    a = F.col("assigned")
    status = (F.when(t <= 0, "neutral").when(a > t, "over").when(a == t, "onTarget")
                .when(a >= t * 0.85, "near").otherwise("filling"))
    bar = F.when(t > 0, F.least(a / t * 100, F.lit(100.0))).otherwise(F.lit(0.0))
    return assigned.select("analyst", "assigned", t.alias("target"), status.alias("status"),
                           bar.alias("bar_pct"))


def plan_problems(retailer_counts: DataFrame, analysts: Sequence[str], plan, split_plan=None,
                  cfg: TaskConfig = DEFAULT) -> DataFrame:
    """What would stop a plan: retailers with no assignment
    (``unassigned_retailer``), Split retailers whose counts do not add up
    (``split_sum_mismatch``), and analysts named in the plan but not listed
    (``unknown_analyst``). Columns: problem, list_name, analyst, expected,
    actual.

    One aggregate per retailer over the counts, the plan and its shares, tagged by their columns; its problems are
    unfolded from that row."""
    spark = retailer_counts.sparkSession
    names = _names(analysts)
    none = {"cnt": F.lit(None).cast("bigint"), "target": F.lit(None).cast("string"),
            "analyst": F.lit(None).cast("string"), "n": F.lit(None).cast("bigint")}

    def tagged(df: DataFrame, name: str, **given: Column) -> DataFrame:
        return df.select(F.col(name).alias("list_name"), *[(none | given)[c].alias(c) for c in none])
    rows = tagged(retailer_counts, cfg.list_name, cnt=F.col("record_count").cast("bigint")).unionByName(
        tagged(plan_frame(spark, plan), "list_name", target=F.col("target"))).unionByName(
        tagged(split_frame(spark, split_plan, names), "list_name", analyst=F.col("analyst"), n=F.col("n")))
    strange = lambda c: F.when(~F.col(c).isin(names), F.col(c))
    per = rows.groupBy("list_name").agg(
        F.max("cnt").alias("cnt"), F.count("target").alias("planned"), F.max(F.col("target") == SPLIT).alias("split"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("asked"),
        F.collect_list(F.when(F.col("target") != SPLIT, strange("target"))).alias("targets"),
        F.collect_list(strange("analyst")).alias("sharers"))
    known, split = F.col("list_name").isNotNull(), F.coalesce("split", F.lit(False))

    def problem(name: str, analyst=None, expected=None, actual=None) -> Column:
        return F.struct(F.lit(name).alias("problem"), (analyst if analyst is not None else none["analyst"]).alias("analyst"),
                        (expected if expected is not None else none["cnt"]).alias("expected"),
                        (actual if actual is not None else none["cnt"]).alias("actual"))
    unknown = F.concat("targets", F.when(split & known, F.col("sharers")).otherwise(F.slice("sharers", 1, 0)))
    found = F.concat(
        F.array(F.when(known & F.col("cnt").isNotNull() & (F.col("planned") == 0),
                       problem("unassigned_retailer", expected=F.col("cnt"))),
                F.when(known & split & (F.col("asked") != F.col("cnt")),
                       problem("split_sum_mismatch", expected=F.col("cnt"), actual=F.col("asked")))),
        F.transform(unknown, lambda x: problem("unknown_analyst", analyst=x)))
    listed = per.select("list_name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return listed.select("x.problem", "list_name", "x.analyst", "x.expected", "x.actual")
