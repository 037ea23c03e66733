"""Task-list fixtures derived from the driver's TPC-H-style tables.

``tasks`` is one task row per ``lineitem`` row; ``v1``/``v2`` are two
versions of it for the comparator; ``analysts``/``plan``/``split_plan`` feed
the launcher. Each Spark builder has a SQL twin (``*_SQL``) that the DuckDB
oracle runs as a CTE, so both engines see the same input.
"""

from __future__ import annotations

import contextlib
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskgrid.config import SPLIT

# Fixed values of the fixture itself (see FIXTURES.md).
ANALYSTS = ("Analyst 1", "Analyst 2", "Analyst 3")
UNKNOWN_ANALYST = "Analyst 9"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(c: Column, mapping: dict[int, str]) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


@functools.lru_cache(maxsize=8)
def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``tasks`` table, derived once per (session, folder) and stored as
    Parquet in the shared checkpoint folder.

    Operators then scan a stored task table, as they would in production:
    filters and projections reach the Parquet reader, and no query repeats
    the four-table join. The write goes through Spark's commit protocol, so
    it survives lost executors and cuts the lineage."""
    from taskgrid.session import scratch_path
    path = scratch_path(spark, "fixture-tasks")
    # written by the tasks of the last join as they are: the wide rows are never shuffled
    with _shuffles_dropped(spark):
        derive_tasks(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Writes in this block drop their shuffle files when they are done; else these stay until the driver happens to
    collect its garbage, beside those of the query that reads the table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def derive_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per lineitem: lineitem ⋈ supplier ⋈ nation ⋈ part.

    ``part``, whose texts are the longest, comes last, so only the columns of
    ``lineitem`` and short names are shuffled. That join is a shuffled one at
    any size: its partitions are the files of the stored table, whatever the
    files and row groups of ``lineitem`` are, and its cost is in proportion to
    the input."""
    l = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    # nation has 25 rows by definition of the schema: a fixed-size broadcast.
    n = F.broadcast(_read(spark, sf_dir, "nation")
                    .select("n_nationkey", "n_name", "n_regionkey"))
    sn = s.join(n, s.s_nationkey == n.n_nationkey)
    j = (l.join(sn, l.l_suppkey == sn.s_suppkey)
          .join(p.hint("merge"), l.l_partkey == p.p_partkey))
    qty = F.col("l_quantity").cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    disc = F.round(F.col("l_discount") * 100).cast("int") % 5
    return j.select(
        F.col("p_type").alias("category"),
        F.col("s_suppkey").cast("bigint").alias("list_id"),
        F.when(qty == 50, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("list_name"),
        F.when(F.col("l_partkey") % 500 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ali"),
        _code(tax, {3: "Draft", 4: "None", 5: "VerifiedQA", 6: "VerifiedQA",
                    7: "VerifiedAdmin", 8: "Rejected"}).alias("polygon_status"),
        F.col("p_name").alias("store_name"),
        F.when(F.col("l_partkey") % 400 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit(" "),
                             F.col("p_name"), F.lit(" St"))).alias("address"),
        F.col("n_name").alias("city"),
        F.col("n_regionkey").cast("string").alias("state"),
        F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("zip"),
        _code(disc, {0: "RETAILSTAT VERIFIED: ROOFTOP", 1: "AGGDATA_VERIFIED: ROOFTOP",
                     2: "STREET ADDRESS: ROOFTOP", 3: "PREMISE: ROOFTOP"}).alias("geo_accuracy"),
        F.when(qty % 10 == 0, "Construction").when(qty % 10 == 1, "Mall Tenant")
         .when(qty % 10 == 2, "Multi-Level").when(qty % 10 == 3, F.lit(None).cast("string"))
         .when(qty % 10 == 4, "Kiosk").otherwise("Normal").alias("construction_flag"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("parent_ali"),
        (F.col("l_partkey") % 180 - 90).cast("double").alias("latitude"),
        (F.col("l_orderkey") % 360 - 180).cast("double").alias("longitude"),
        F.col("l_returnflag").alias("batch"),
    )


TASKS_SQL = """tasks AS (
  SELECT
    p.p_type AS category,
    CAST(s.s_suppkey AS BIGINT) AS list_id,
    CASE WHEN CAST(l.l_quantity AS INT) = 50 THEN NULL ELSE s.s_name END AS list_name,
    CASE WHEN l.l_partkey % 500 = 0 THEN NULL ELSE l.l_orderkey * 10 + l.l_linenumber END AS ali,
    CASE CAST(round(l.l_tax * 100) AS INT)
      WHEN 3 THEN 'Draft' WHEN 4 THEN 'None' WHEN 5 THEN 'VerifiedQA'
      WHEN 6 THEN 'VerifiedQA' WHEN 7 THEN 'VerifiedAdmin' WHEN 8 THEN 'Rejected' END AS polygon_status,
    p.p_name AS store_name,
    CASE WHEN l.l_partkey % 400 = 1 THEN NULL
         ELSE CAST(l.l_orderkey AS VARCHAR) || ' ' || p.p_name || ' St' END AS address,
    n.n_name AS city,
    CAST(n.n_regionkey AS VARCHAR) AS state,
    lpad(CAST(l.l_suppkey AS VARCHAR), 5, '0') AS zip,
    CASE CAST(round(l.l_discount * 100) AS INT) % 5
      WHEN 0 THEN 'RETAILSTAT VERIFIED: ROOFTOP' WHEN 1 THEN 'AGGDATA_VERIFIED: ROOFTOP'
      WHEN 2 THEN 'STREET ADDRESS: ROOFTOP' WHEN 3 THEN 'PREMISE: ROOFTOP' END AS geo_accuracy,
    CASE CAST(l.l_quantity AS INT) % 10
      WHEN 0 THEN 'Construction' WHEN 1 THEN 'Mall Tenant' WHEN 2 THEN 'Multi-Level'
      WHEN 3 THEN NULL WHEN 4 THEN 'Kiosk' ELSE 'Normal' END AS construction_flag,
    CASE WHEN l.l_linestatus = 'O' THEN l.l_partkey END AS parent_ali,
    CAST(l.l_partkey % 180 - 90 AS DOUBLE) AS latitude,
    CAST(l.l_orderkey % 360 - 180 AS DOUBLE) AS longitude,
    l.l_returnflag AS batch
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old version of the list: batches A and R."""
    return tasks(spark, sf_dir).filter(F.col("batch").isin("A", "R"))


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New version: batches N and R, with some ALIs, statuses, addresses edited."""
    t = tasks(spark, sf_dir).filter(F.col("batch").isin("N", "R"))
    k = (F.col("latitude") + 90).cast("int")
    return t.withColumns({
        "ali": F.when(k % 5 == 0, F.col("ali") + 1000000000).otherwise(F.col("ali")),
        "polygon_status": F.when(k % 7 == 0, F.lit(None).cast("string"))
                           .otherwise(F.col("polygon_status")),
        "address": F.when(k % 11 == 0, F.concat(F.col("address"), F.lit(" Unit 2")))
                    .otherwise(F.col("address")),
    })


V_SQL = """v1 AS (SELECT * FROM tasks WHERE batch IN ('A', 'R')),
v2 AS (
  SELECT * REPLACE (
    CASE WHEN CAST(latitude + 90 AS INT) % 5 = 0 THEN ali + 1000000000 ELSE ali END AS ali,
    CASE WHEN CAST(latitude + 90 AS INT) % 7 = 0 THEN NULL ELSE polygon_status END AS polygon_status,
    CASE WHEN CAST(latitude + 90 AS INT) % 11 = 0 THEN address || ' Unit 2' ELSE address END AS address)
  FROM tasks WHERE batch IN ('N', 'R')
)"""


def analysts(spark: SparkSession, names=ANALYSTS) -> DataFrame:
    """The analyst list ``(position, analyst)``."""
    return spark.createDataFrame(list(enumerate(names)), "position int, analyst string")


ANALYSTS_SQL = "analysts AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{a}')" for i, a in enumerate(ANALYSTS)) + ") AS a(position, analyst))"


def retailers(tasks_df: DataFrame) -> DataFrame:
    """Retailers present in the data with their id and row count."""
    return (tasks_df.filter(F.col("list_name").isNotNull())
            .groupBy("list_name")
            .agg(F.min("list_id").alias("list_id"), F.count(F.lit(1)).alias("cnt")))


RETAILERS_SQL = """retailers AS (
  SELECT list_name, min(list_id) AS list_id, count(*) AS cnt
  FROM tasks WHERE list_name IS NOT NULL GROUP BY list_name
)"""


def plan(spark: SparkSession, tasks_df: DataFrame, names=ANALYSTS) -> DataFrame:
    """``(list_name, target)``: by ``list_id % 4`` an analyst position, 3 = Split."""
    pos = {i: a for i, a in enumerate(names)}
    r = retailers(tasks_df)
    m = F.col("list_id") % 4
    target = F.when(m == 3, F.lit(SPLIT))
    for i, a in pos.items():
        target = target.when(m == i, F.lit(a))
    return r.select("list_name", target.alias("target"))


PLAN_SQL = """plan AS (
  SELECT r.list_name, CASE WHEN r.list_id % 4 = 3 THEN 'Split' ELSE a.analyst END AS target
  FROM retailers r LEFT JOIN analysts a ON r.list_id % 4 = a.position
)"""


def split_plan(spark: SparkSession, tasks_df: DataFrame, names=ANALYSTS) -> DataFrame:
    """``(list_name, analyst, n)`` for Split retailers: ``cnt div k`` each,
    the remainder to the first analyst."""
    k = len(names)
    r = retailers(tasks_df).filter(F.col("list_id") % 4 == 3)
    each = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(a).alias("analyst")) for i, a in enumerate(names)
    ])).alias("a")
    return (r.select("list_name", "cnt", each)
             .select("list_name", F.col("a.analyst").alias("analyst"),
                     (F.expr(f"cnt div {k}") + F.when(F.col("a.position") == 0, F.col("cnt") % k)
                      .otherwise(F.lit(0))).cast("bigint").alias("n")))


SPLIT_PLAN_SQL = """split_plan AS (
  SELECT r.list_name, a.analyst,
         CAST(r.cnt // (SELECT count(*) FROM analysts)
              + CASE WHEN a.position = 0 THEN r.cnt % (SELECT count(*) FROM analysts) ELSE 0 END AS BIGINT) AS n
  FROM retailers r JOIN analysts a ON TRUE
  WHERE r.list_id % 4 = 3
)"""


def bad_plan(spark: SparkSession, tasks_df: DataFrame, names=ANALYSTS) -> tuple[DataFrame, DataFrame]:
    """A broken plan: the first whole retailer of position 0 is missing, the
    first Split retailer's first share is one too many, and the first retailer
    of position 1 goes to an analyst who is not listed."""
    r = retailers(tasks_df)
    firsts = r.groupBy((F.col("list_id") % 4).alias("m")).agg(F.min("list_id").alias("first_id"))
    p = plan(spark, tasks_df, names).join(r.select("list_name", "list_id"), "list_name")
    p = p.join(F.broadcast(firsts), (p.list_id % 4) == firsts.m, "left")
    is_first = F.col("list_id") == F.col("first_id")
    bp = (p.filter(~(is_first & (F.col("m") == 0)))
           .select("list_name",
                   F.when(is_first & (F.col("m") == 1), F.lit(UNKNOWN_ANALYST))
                    .otherwise(F.col("target")).alias("target")))
    sp = split_plan(spark, tasks_df, names).join(r.select("list_name", "list_id"), "list_name")
    first_split = firsts.filter(F.col("m") == 3).select("first_id")
    sp = sp.join(F.broadcast(first_split), sp.list_id == first_split.first_id, "left")
    bsp = sp.select("list_name", "analyst",
                    (F.col("n") + F.when(F.col("first_id").isNotNull() & (F.col("analyst") == names[0]), 1)
                     .otherwise(0)).cast("bigint").alias("n"))
    return bp, bsp


BAD_PLAN_SQL = f"""firsts AS (SELECT list_id % 4 AS m, min(list_id) AS first_id FROM retailers GROUP BY 1),
bad_plan AS (
  SELECT p.list_name,
         CASE WHEN r.list_id % 4 = 1 AND r.list_id = f.first_id THEN '{UNKNOWN_ANALYST}' ELSE p.target END AS target
  FROM plan p JOIN retailers r USING (list_name) JOIN firsts f ON r.list_id % 4 = f.m
  WHERE NOT (r.list_id % 4 = 0 AND r.list_id = f.first_id)
),
bad_split_plan AS (
  SELECT s.list_name, s.analyst,
         CAST(s.n + CASE WHEN r.list_id = f.first_id AND s.analyst = '{ANALYSTS[0]}' THEN 1 ELSE 0 END AS BIGINT) AS n
  FROM split_plan s JOIN retailers r USING (list_name) JOIN firsts f ON f.m = 3
)"""


def with_ctes(body: str, *ctes: str) -> str:
    """Prefix ``body`` with the fixture CTEs it needs (in dependency order).

    ``body`` may open with ``, name AS (...)`` to add CTEs of its own."""
    order = [TASKS_SQL, V_SQL, ANALYSTS_SQL, RETAILERS_SQL, PLAN_SQL, SPLIT_PLAN_SQL, BAD_PLAN_SQL]
    wanted = set(ctes) | {TASKS_SQL}
    if BAD_PLAN_SQL in wanted:
        wanted |= {PLAN_SQL, SPLIT_PLAN_SQL}
    if PLAN_SQL in wanted or SPLIT_PLAN_SQL in wanted:
        wanted |= {ANALYSTS_SQL, RETAILERS_SQL}
    parts = [c for c in order if c in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + body
