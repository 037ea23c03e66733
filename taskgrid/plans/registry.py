"""Registered queries and their DuckDB oracle SQL.

Every query reads the driver's tables through the fixtures (``tasks`` is
derived from ``lineitem`` and its dimensions), so its work grows with the
scale factor. ``ORACLE[key]`` computes the same result in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taskgrid.sources import fixtures as fx
from taskgrid.operators import quality as q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

VERIFIED_SQL = "('RETAILSTAT VERIFIED: ROOFTOP', 'AGGDATA_VERIFIED: ROOFTOP')"
FLAG_VALUES = ("Construction", "Kiosk", "Mall Tenant", "Multi-Level", "Normal")
STATUS_VALUES = ("Draft", "None", "Normal", "Rejected", "VerifiedAdmin", "VerifiedQA")


def pct_sql(n: str, t: str) -> str:
    return f"round_even(CAST({n} AS DOUBLE) / NULLIF({t}, 0) * 100 * 10, 0) / 10"


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return fx.tasks(spark, d)


W = fx.with_ctes
FLAG = "coalesce(construction_flag, 'Normal')"
STATUS_FILL = "coalesce(polygon_status, 'Normal')"
S_OPEN = "coalesce(polygon_status, 'None') IN ('None', 'Draft')"
G_VER = f"coalesce(geo_accuracy IN {VERIFIED_SQL}, false)"
MARKED_SQL = (f"(coalesce(polygon_status, 'None') IN ('VerifiedQA', 'VerifiedAdmin') "
              f"OR {FLAG} IN ('Mall Tenant', 'Multi-Level') "
              f"OR ({S_OPEN} AND {FLAG} = 'Normal' AND {G_VER}))")
PENDING_SQL = (f"({S_OPEN} AND ({FLAG} = 'Construction' OR ({FLAG} = 'Normal' AND NOT {G_VER})))")
MT_ERR = "(construction_flag = 'Mall Tenant' AND polygon_status IS NOT NULL)"
ML_ERR = "(construction_flag = 'Multi-Level' AND polygon_status IS NOT NULL)"
CO_ERR = f"(construction_flag = 'Construction' AND (polygon_status IS NOT NULL OR {G_VER}))"


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


# -- analyser -------------------------------------------------------------------
register("total_records", W("SELECT count(*) AS total_records FROM tasks"))(
    lambda s, d: q.total_records(tasks(s, d)))
register("unique_retailers", W("SELECT DISTINCT list_name FROM tasks"))(
    lambda s, d: q.unique_retailers(tasks(s, d)))
register("unique_retailers_count",
         W("SELECT count(DISTINCT list_name) AS unique_retailers_count FROM tasks"))(
    lambda s, d: q.unique_retailers_count(tasks(s, d)))
register("records_per_retailer", W(
    "SELECT list_name, count(*) AS record_count FROM tasks "
    "WHERE list_name IS NOT NULL GROUP BY list_name ORDER BY record_count DESC, list_name"))(
    lambda s, d: q.records_per_retailer(tasks(s, d)))


def _pivot_sql(expr: str, values) -> str:
    cols = ", ".join(_cnt(f"{expr} = '{v}'") + f' AS "{v}"' for v in values)
    return W(f'SELECT list_name, {cols}, count(*) AS "Total" FROM tasks '
             "WHERE list_name IS NOT NULL GROUP BY list_name")


register("construction_flag_breakdown", _pivot_sql(FLAG, FLAG_VALUES))(
    lambda s, d: q.construction_flag_breakdown(tasks(s, d), values=FLAG_VALUES))
register("polygon_status_breakdown", _pivot_sql(STATUS_FILL, STATUS_VALUES))(
    lambda s, d: q.polygon_status_breakdown(tasks(s, d), values=STATUS_VALUES))


def _long_sql(expr: str) -> str:
    return W(f"SELECT list_name, {expr} AS label, count(*) AS n FROM tasks "
             "WHERE list_name IS NOT NULL GROUP BY ALL")


register("construction_flag_long", _long_sql(FLAG))(lambda s, d: q.construction_flag_long(tasks(s, d)))
register("polygon_status_long", _long_sql(STATUS_FILL))(lambda s, d: q.polygon_status_long(tasks(s, d)))

DUP_SQL = ("count(DISTINCT ali) AS unique_ali, "
           "count(*) - count(DISTINCT ali) - CASE WHEN count(*) > count(ali) THEN 1 ELSE 0 END "
           "AS duplicate_count")
register("duplicate_ali_summary", W(f"SELECT count(*) AS total, {DUP_SQL} FROM tasks"))(
    lambda s, d: q.duplicate_ali_summary(tasks(s, d)))
register("duplicate_ali_rows", W(
    "SELECT t.* FROM tasks t WHERE EXISTS (SELECT 1 FROM "
    "(SELECT ali FROM tasks GROUP BY ali HAVING count(*) > 1) k "
    "WHERE k.ali IS NOT DISTINCT FROM t.ali)"))(
    lambda s, d: q.duplicate_ali_rows(tasks(s, d)))


def _stack_sql(items, total="t") -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS label, {c} AS count, {pct_sql(c, total)} AS pct FROM a"
        for label, c in items)


register("construction_flag_percentages", W(
    ", a AS (SELECT count(*) AS t, " + _cnt(FLAG + " = 'Construction'") + " AS c0, "
    + _cnt(FLAG + " = 'Mall Tenant'") + " AS c1, " + _cnt(FLAG + " = 'Multi-Level'") + " AS c2, "
    + _cnt(FLAG + " = 'Normal'") + " AS c3 FROM tasks)\n"
    + _stack_sql([("Construction", "c0"), ("Mall Tenant", "c1"), ("Multi Level", "c2"),
                  ("Normal", "c3")])))(
    lambda s, d: q.construction_flag_percentages(tasks(s, d)))
register("polygon_status_percentages", W(
    ", a AS (SELECT count(*) AS t, " + _cnt("polygon_status = 'VerifiedQA'") + " AS v "
    "FROM tasks), b AS (SELECT t, v, t - v AS u FROM a)\n"
    + _stack_sql([("Verified QA", "v"), ("Unverified", "u")]).replace("FROM a", "FROM b")))(
    lambda s, d: q.polygon_status_percentages(tasks(s, d)))
register("parent_ali_percentages", W(
    ", a AS (SELECT count(*) AS t, count(parent_ali) AS c, count(*) - count(parent_ali) AS u "
    "FROM tasks)\n" + _stack_sql([("connected", "c"), ("unknown", "u")])))(
    lambda s, d: q.parent_ali_percentages(tasks(s, d)))
register("parent_ali_per_retailer", W(
    'SELECT list_name, count(parent_ali) AS "Connected", count(*) - count(parent_ali) AS "Unknown", '
    'count(*) AS "Total" FROM tasks WHERE list_name IS NOT NULL GROUP BY list_name'))(
    lambda s, d: q.parent_ali_per_retailer(tasks(s, d)))
register("qc_mall_tenant_errors", W(f"SELECT * FROM tasks WHERE {MT_ERR}"))(
    lambda s, d: q.qc_mall_tenant_errors(tasks(s, d)))
register("qc_multi_level_errors", W(f"SELECT * FROM tasks WHERE {ML_ERR}"))(
    lambda s, d: q.qc_multi_level_errors(tasks(s, d)))
register("qc_construction_errors", W(f"SELECT * FROM tasks WHERE {CO_ERR}"))(
    lambda s, d: q.qc_construction_errors(tasks(s, d)))
QC_SQL = (f"{_cnt(MT_ERR)} AS mall_tenant_errors, {_cnt(ML_ERR)} AS multi_level_errors, "
          f"{_cnt(CO_ERR)} AS construction_errors, "
          f"{_cnt(MT_ERR)} + {_cnt(ML_ERR)} + {_cnt(CO_ERR)} AS total_errors")
register("qc_error_totals", W(f"SELECT {QC_SQL} FROM tasks"))(
    lambda s, d: q.qc_error_totals(tasks(s, d)))
register("classify_marked", W(
    f"SELECT *, CASE WHEN {MARKED_SQL} THEN 'marked' WHEN {PENDING_SQL} THEN 'pending' "
    "ELSE 'neither' END AS coverage FROM tasks"))(
    lambda s, d: q.classify_marked(tasks(s, d)))
COVERAGE_SQL = (f"{_cnt(MARKED_SQL)} AS marked_count, {pct_sql(_cnt(MARKED_SQL), 'count(*)')} AS marked_pct, "
                f"{_cnt(PENDING_SQL)} AS pending_count, {pct_sql(_cnt(PENDING_SQL), 'count(*)')} AS pending_pct, "
                + _cnt("polygon_status IN ('VerifiedQA', 'VerifiedAdmin')") + " AS polygon_done_count, "
                + _cnt(PENDING_SQL) + " AS polygon_missing_count")
register("polygon_coverage", W(
    f"SELECT count(*) AS total, {COVERAGE_SQL}, "
    + _cnt(FLAG + " = 'Mall Tenant'") + " AS mall_tenant_count, "
    + _cnt(FLAG + " = 'Multi-Level'") + " AS multi_level_count, "
    + _cnt(FLAG + " = 'Construction'") + " AS construction_count FROM tasks"))(
    lambda s, d: q.polygon_coverage(tasks(s, d)))


def _full_sql() -> str:
    counts = {
        "construction": _cnt(FLAG + " = 'Construction'"),
        "mall_tenant": _cnt(FLAG + " = 'Mall Tenant'"),
        "multi_level": _cnt(FLAG + " = 'Multi-Level'"),
        "normal": _cnt(FLAG + " = 'Normal'"),
        "verified_qa": _cnt("polygon_status = 'VerifiedQA'"),
        "unverified": "count(*) - " + _cnt("polygon_status = 'VerifiedQA'"),
        "connected": "count(parent_ali)",
        "unknown": "count(*) - count(parent_ali)",
    }
    parts = ["count(*) AS total_records", "count(DISTINCT list_name) AS unique_retailers_count", DUP_SQL]
    for k, c in counts.items():
        parts += [f"{c} AS {k}_count", f"{pct_sql(c, 'count(*)')} AS {k}_pct"]
    parts += [QC_SQL, COVERAGE_SQL]
    return W("SELECT " + ",\n  ".join(parts) + " FROM tasks")


register("full_analysis", _full_sql())(lambda s, d: q.full_analysis_row(tasks(s, d)))
NEEDS_SQL = f"NOT {G_VER}"


register("full_analysis_profile", W(
    ", t AS (SELECT * FROM tasks WHERE list_name IS NOT NULL)\n"
    "SELECT 'records' AS section, list_name, CAST(NULL AS VARCHAR) AS label, count(*) AS n FROM t GROUP BY list_name "
    f"UNION ALL SELECT 'construction_flag', list_name, {FLAG}, count(*) FROM t GROUP BY ALL "
    f"UNION ALL SELECT 'polygon_status', list_name, {STATUS_FILL}, count(*) FROM t GROUP BY ALL "
    "UNION ALL SELECT 'parent_ali', list_name, CASE WHEN parent_ali IS NULL THEN 'Unknown' ELSE 'Connected' END, "
    "count(*) FROM t GROUP BY ALL "
    f"UNION ALL SELECT 'needs_work', list_name, CASE WHEN NOT {G_VER} THEN 'yes' ELSE 'no' END, count(*) FROM t GROUP BY ALL"))(
    lambda s, d: q.grouped_profile(tasks(s, d)))
register("needs_work", W(f"SELECT * FROM tasks WHERE {NEEDS_SQL}"))(
    lambda s, d: q.needs_work(tasks(s, d)))
register("needs_work_preview", W(
    f"SELECT list_name, {_cnt(NEEDS_SQL)} AS needs_work_count FROM tasks "
    "WHERE list_name IS NOT NULL GROUP BY list_name"))(
    lambda s, d: q.needs_work_preview(tasks(s, d)))


@register("launch_subset", W(
    f", pre AS (SELECT list_name FROM tasks WHERE list_name IS NOT NULL GROUP BY list_name "
    f"HAVING {_cnt(NEEDS_SQL)} > 0)\n"
    f"SELECT * FROM tasks WHERE {NEEDS_SQL} AND list_name IN (SELECT list_name FROM pre)"))
def _launch_subset(s, d):
    # The screen preselects every retailer with work left; launch those.
    t = tasks(s, d)
    pre = q.needs_work_preview(t).filter("needs_work_count > 0").select("list_name")
    return q.launch_subset(t, selected=pre)


LAUNCHED_SQL = (f", pre AS (SELECT list_name FROM tasks WHERE list_name IS NOT NULL GROUP BY list_name "
                f"HAVING {_cnt(NEEDS_SQL)} > 0), launched AS (SELECT * FROM tasks WHERE {NEEDS_SQL} "
                "AND list_name IN (SELECT list_name FROM pre))\n")
register("launch_summary", W(
    LAUNCHED_SQL + "SELECT CASE WHEN count(*) = 0 THEN NULL WHEN count(DISTINCT list_name) = 1 THEN 'single' "
    "ELSE 'multi' END AS mode, count(*) AS total_alis, count(DISTINCT list_name) AS retailers FROM launched"))(
    lambda s, d: q.launch_summary(_launch_subset(s, d)))
register("launch_counts", W(
    LAUNCHED_SQL + "SELECT list_name, count(*) AS record_count FROM launched GROUP BY list_name"))(
    lambda s, d: q.records_per_retailer(_launch_subset(s, d)))


# -- comparator -----------------------------------------------------------------
from taskgrid.operators import compare as c  # noqa: E402

LAYOUT = ("list_name", "ali", "address", "city", "zip", "polygon_status")
CMP_CTE = (", d1 AS (SELECT " + ", ".join(LAYOUT) + " FROM v1), d2 AS (SELECT "
           + ", ".join(LAYOUT) + " FROM v2)")


def WV(body: str) -> str:
    return fx.with_ctes(CMP_CTE + "\n" + body, fx.V_SQL)


def v1(s, d):
    return fx.v1(s, d)


def v2(s, d):
    return fx.v2(s, d)


def _exists(a: str, b: str, key: str, neg: bool = False) -> str:
    return (f"{'NOT ' if neg else ''}EXISTS (SELECT 1 FROM {b} WHERE {b}.{key} "
            f"IS NOT DISTINCT FROM {a}.{key})")


def _unmatched_cte(key: str) -> str:
    return (f", u AS (SELECT *, 'File 1' AS source FROM d1 WHERE {_exists('d1', 'd2', key, True)} "
            f"UNION ALL SELECT *, 'File 2' AS source FROM d2 WHERE {_exists('d2', 'd1', key, True)})")


def _conflicts_sql(key: str, check: str) -> str:
    others = [x for x in LAYOUT if x != key]
    order = ", ".join(f"{x} NULLS FIRST" for x in others)
    strings = {"list_name", "address", "city", "zip", "polygon_status"}

    def side(t: str, suf: str) -> str:
        return ", ".join(
            (f"coalesce({t}.{x}, '')" if x in strings else f"{t}.{x}") + f" AS {x}{suf}" for x in others)

    firsts = ", ".join(
        f"{f} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn "
        f"FROM {d} WHERE {key} IS NOT NULL) WHERE rn = 1)" for f, d in (("f1", "d1"), ("f2", "d2")))
    return WV(f", {firsts}\nSELECT f1.{key}, {side('f1', '_file1')}, {side('f2', '_file2')} "
              f"FROM f1 JOIN f2 ON f1.{key} = f2.{key} "
              f"WHERE coalesce(CAST(f1.{check} AS VARCHAR), '') <> coalesce(CAST(f2.{check} AS VARCHAR), '')")


for _key, _check, _suffix in (("ali", "address", "ali"), ("address", "ali", "address")):
    register(f"matched_by_{_suffix}", WV(f"SELECT * FROM d1 WHERE {_exists('d1', 'd2', _key)}"))(
        lambda s, d, k=_key: c.matched(v1(s, d), v2(s, d), k))
    register(f"only_in_one_by_{_suffix}", WV(
        _unmatched_cte(_key) + "\nSELECT *, CASE WHEN count(*) OVER (PARTITION BY "
        f"{_key}) > 1 THEN '⚠️ Yes' ELSE 'No' END AS duplicate FROM u"))(
        lambda s, d, k=_key: c.only_in_one(v1(s, d), v2(s, d), k))
    register("unmatched_duplicate_count" + ("" if _key == "ali" else "_by_address"), WV(
        _unmatched_cte(_key) + f"\nSELECT count(*) - count(DISTINCT {_key}) - CASE WHEN count(*) > "
        f"count({_key}) THEN 1 ELSE 0 END AS unmatched_duplicate_count FROM u"))(
        lambda s, d, k=_key: c.unmatched_duplicate_count(v1(s, d), v2(s, d), k))
    register(f"conflicts_by_{_suffix}", _conflicts_sql(_key, _check))(
        lambda s, d, k=_key, ch=_check: c.conflicts(v1(s, d), v2(s, d), k, ch))

_OLD = ", ".join(f"o.{x} AS {x}_old" for x in LAYOUT if x != "address")
_NEW = ", ".join(f"n.{x} AS {x}_new" for x in LAYOUT if x != "address")
_PAIR_COLS = ("o.list_name AS list_name_old, o.ali AS ali_old, {addr} AS address, o.city AS city_old, "
              "o.zip AS zip_old, o.polygon_status AS polygon_status_old, " + _NEW)
PAIRS_CTE = (", p AS (SELECT " + _PAIR_COLS.format(addr="o.address") +
             " FROM d1 o JOIN d2 n ON o.address IS NOT DISTINCT FROM n.address)")
BUCKETS_SQL = {
    "changed_lost": "coalesce(ali_old <> ali_new, true) AND polygon_status_old IS NOT NULL AND polygon_status_new IS NULL",
    "changed_never": "coalesce(ali_old <> ali_new, true) AND polygon_status_old IS NULL AND polygon_status_new IS NULL",
    "lost_only": "coalesce(ali_old = ali_new, false) AND polygon_status_old IS NOT NULL AND polygon_status_new IS NULL",
    "clean": "coalesce(ali_old = ali_new, false) AND coalesce(polygon_status_old = polygon_status_new, false)",
}
MIGRATION_CTE = (
    ", m AS (SELECT " + _PAIR_COLS.format(addr="CASE WHEN o._in IS NULL THEN n.address ELSE o.address END")
    + ", CASE WHEN o._in IS NULL THEN 'right_only' WHEN n._in IS NULL THEN 'left_only' ELSE 'both' END AS side "
    "FROM (SELECT *, TRUE AS _in FROM d1) o FULL JOIN (SELECT *, TRUE AS _in FROM d2) n "
    "ON o.address IS NOT DISTINCT FROM n.address)")

register("migration_join", WV(MIGRATION_CTE + "\nSELECT * FROM m"))(
    lambda s, d: c.migration_join(v1(s, d), v2(s, d)))
register("migration_only_old", WV(f"SELECT * FROM d1 WHERE {_exists('d1', 'd2', 'address', True)}"))(
    lambda s, d: c.migration_only_old(v1(s, d), v2(s, d)))
register("migration_only_new", WV(f"SELECT * FROM d2 WHERE {_exists('d2', 'd1', 'address', True)}"))(
    lambda s, d: c.migration_only_new(v1(s, d), v2(s, d)))
for _key, _bucket in (("migration_changed_status_lost", "changed_lost"),
                      ("migration_changed_never_marked", "changed_never"),
                      ("migration_status_lost", "lost_only"),
                      ("migration_clean", "clean")):
    register(_key, WV(PAIRS_CTE + f"\nSELECT * FROM p WHERE {BUCKETS_SQL[_bucket]}"))(
        lambda s, d, b=_bucket: c.migration_bucket(v1(s, d), v2(s, d), b))

_CASE = ("CASE WHEN side = 'left_only' THEN 'only_old' WHEN side = 'right_only' THEN 'only_new' "
         + " ".join(f"WHEN {cond} THEN '{b}'" for b, cond in BUCKETS_SQL.items()) + " ELSE 'other' END")
register("migration_summary", WV(
    MIGRATION_CTE + f", x AS (SELECT {_CASE} AS bk FROM m)\n"
    "SELECT b.bucket, count(x.bk) AS row_count FROM (VALUES ('only_old'), ('only_new'), ('changed_lost'), "
    "('changed_never'), ('lost_only'), ('clean'), ('other')) AS b(bucket) "
    "LEFT JOIN x ON x.bk = b.bucket GROUP BY b.bucket"))(
    lambda s, d: c.migration_summary(v1(s, d), v2(s, d)))

_CLASS_COUNTS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN {BUCKETS_SQL[b]} THEN 1 ELSE 0 END), 0) AS DECIMAL(38,0)) AS {b}"
    for b in ("changed_lost", "changed_never", "lost_only", "clean"))
register("migration_classes", WV(
    ", k AS (SELECT address, sum(o) AS old_rows, sum(n) AS new_rows FROM (SELECT address, 1 AS o, 0 AS n FROM d1 "
    "UNION ALL SELECT address, 0, 1 FROM d2) GROUP BY address), p AS (SELECT " + _PAIR_COLS.format(addr="o.address")
    + " FROM d1 o JOIN d2 n ON o.address = n.address), "
    f"b AS (SELECT address, count(*) AS pairs, {_CLASS_COUNTS} FROM p GROUP BY address)\n"
    "SELECT k.address, CAST(old_rows AS BIGINT) AS old_rows, CAST(new_rows AS BIGINT) AS new_rows, "
    "CASE WHEN b.pairs IS NOT NULL THEN 'both' WHEN new_rows = 0 THEN 'left_only' WHEN old_rows = 0 THEN 'right_only' "
    "ELSE 'apart' END AS side, CAST(coalesce(b.pairs, 0) AS DECIMAL(38,0)) AS pairs, "
    + ", ".join(f"CAST(coalesce(b.{x}, 0) AS DECIMAL(38,0)) AS {x}"
                for x in ("changed_lost", "changed_never", "lost_only", "clean"))
    + " FROM k LEFT JOIN b ON b.address = k.address"))(
    lambda s, d: c.migration_classes(v1(s, d), v2(s, d)))
register("migration_members", WV(
    "SELECT *, 'old' AS version FROM d1 UNION ALL SELECT *, 'new' AS version FROM d2"))(
    lambda s, d: c.migration_members(v1(s, d), v2(s, d)))


# -- launcher -------------------------------------------------------------------
from taskgrid.operators import assign as a  # noqa: E402

TASK_COLS = ("category", "list_id", "list_name", "ali", "polygon_status", "store_name", "address",
             "city", "state", "zip", "geo_accuracy", "construction_flag", "parent_ali", "latitude",
             "longitude", "batch")
SEED = 0
H_SQL = ("md5(concat_ws('|', '" + str(SEED) + "', "
         + ", ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"
                      for x in TASK_COLS) + "))")
NAMES = fx.ANALYSTS
N = len(NAMES)
WP = lambda body: fx.with_ctes(body, fx.PLAN_SQL, fx.SPLIT_PLAN_SQL)
WB = lambda body: fx.with_ctes(body, fx.BAD_PLAN_SQL)
IN_NAMES = "(SELECT analyst FROM analysts)"

SPLIT_ROWS_SQL = (
    ", sr AS (SELECT list_name FROM plan WHERE target = 'Split'),\n"
    f"ranked AS (SELECT t.*, row_number() OVER (PARTITION BY list_name ORDER BY {H_SQL}) - 1 AS rk "
    "FROM tasks t WHERE list_name IN (SELECT list_name FROM sr)),\n"
    "sl AS (SELECT sp.list_name, sp.analyst, sp.n, sum(sp.n) OVER (PARTITION BY sp.list_name "
    "ORDER BY a.position ROWS UNBOUNDED PRECEDING) AS hi FROM split_plan sp JOIN analysts a USING (analyst)),\n"
    "split_rows AS (SELECT r.* EXCLUDE (rk), sl.analyst FROM ranked r JOIN sl "
    "ON r.list_name = sl.list_name AND r.rk >= sl.hi - sl.n AND r.rk < sl.hi),\n"
    f"whole_rows AS (SELECT t.*, p.target AS analyst FROM tasks t JOIN plan p ON t.list_name = p.list_name "
    f"WHERE p.target IN {IN_NAMES}),\n"
    "assigned AS (SELECT * FROM whole_rows UNION ALL SELECT * FROM split_rows)")


def _plan_inputs(s, d):
    t = tasks(s, d)
    return t, fx.plan(s, t), fx.split_plan(s, t)


def _applied(s, d):
    t, p, sp = _plan_inputs(s, d)
    return t, a.apply_plan(t, NAMES, p, sp, seed=SEED)


register("retailer_mode", W(
    "SELECT CASE WHEN count(DISTINCT list_name) = 1 THEN 'single' ELSE 'multi' END AS mode, "
    "count(DISTINCT list_name) AS retailers FROM tasks"))(
    lambda s, d: a.retailer_mode(tasks(s, d)))
register("split_target", W(
    f"SELECT count(*) AS total, {N} AS analysts, count(*) // {N} AS target, count(*) % {N} AS remainder "
    "FROM tasks"))(lambda s, d: a.split_target(tasks(s, d), N))
register("equal_split", fx.with_ctes(
    f", ranked AS (SELECT t.*, row_number() OVER (ORDER BY {H_SQL}) - 1 AS rk FROM tasks t),\n"
    f"c AS (SELECT count(*) // {N} AS tg, count(*) % {N} AS rem FROM tasks),\n"
    "sl AS (SELECT a.analyst, CASE WHEN a.position = 0 THEN 0 ELSE c.rem + a.position * c.tg END AS lo, "
    "c.rem + (a.position + 1) * c.tg AS hi FROM analysts a, c)\n"
    "SELECT r.* EXCLUDE (rk), sl.analyst FROM ranked r JOIN sl ON r.rk >= sl.lo AND r.rk < sl.hi",
    fx.ANALYSTS_SQL))(lambda s, d: a.equal_split(tasks(s, d), NAMES, seed=SEED))


@register("fixed_count_split", WP(SPLIT_ROWS_SQL + "\nSELECT * FROM split_rows"))
def _fixed_count_split(s, d):
    t, p, sp = _plan_inputs(s, d)
    return a.split_by_counts(t, sp, NAMES, seed=SEED)


register("apply_plan", WP(SPLIT_ROWS_SQL + "\nSELECT * FROM assigned"))(
    lambda s, d: _applied(s, d)[1])


@register("unassigned_count", WP(
    ", assigned AS (SELECT t.ali FROM tasks t JOIN plan p ON t.list_name = p.list_name "
    f"WHERE p.target IN {IN_NAMES} OR p.target = 'Split')\n"
    "SELECT count(*) AS unassigned_count FROM (SELECT ali FROM tasks EXCEPT SELECT ali FROM assigned)"))
def _unassigned(s, d):
    t, asg = _applied(s, d)
    return a.unassigned_count(t, asg)


@register("assignment_summary", WP(
    ", per AS (SELECT analyst, sum(v) AS tasks_assigned, "
    "string_agg(DISTINCT list_name, ', ' ORDER BY list_name) AS assigned_retailers FROM ("
    f"SELECT p.target AS analyst, r.list_name, r.cnt AS v FROM retailers r JOIN plan p USING (list_name) "
    f"WHERE p.target IN {IN_NAMES} "
    "UNION ALL SELECT sp.analyst, sp.list_name, sp.n FROM split_plan sp WHERE sp.n > 0) GROUP BY analyst),\n"
    "body AS (SELECT a.position, a.analyst, CAST(coalesce(per.tasks_assigned, 0) AS BIGINT) AS tasks_assigned, "
    "coalesce(per.assigned_retailers, '') AS assigned_retailers FROM analysts a LEFT JOIN per USING (analyst)),\n"
    "tot AS (SELECT sum(tasks_assigned) AS t FROM body)\n"
    f"SELECT analyst, tasks_assigned, CAST(coalesce({pct_sql('tasks_assigned', 't')}, 0.0) AS VARCHAR) || '%' "
    "AS percentage, assigned_retailers FROM body, tot "
    "UNION ALL SELECT 'Total', CAST(t AS BIGINT), '100.0%', '' FROM tot"))
def _summary(s, d):
    return a.assignment_summary(_applied(s, d)[1], NAMES)


SHARES_SQL = (
    ", shares AS (SELECT p.target AS analyst, r.list_name, r.cnt AS n FROM retailers r JOIN plan p USING (list_name) "
    f"WHERE p.target IN {IN_NAMES} UNION ALL SELECT sp.analyst, sp.list_name, sp.n FROM split_plan sp WHERE sp.n > 0)")
register("assignment_retailers", WP(
    SHARES_SQL + "\nSELECT analyst, list_name, CAST(sum(n) AS BIGINT) AS n FROM shares GROUP BY analyst, list_name"))(
    lambda s, d: a.assignment_retailers(_applied(s, d)[1]))


@register("write_assignments_summary", WP(
    SHARES_SQL + ", per AS (SELECT analyst, sum(n) AS v FROM shares GROUP BY analyst), body AS (SELECT a.analyst, "
    "CAST(coalesce(per.v, 0) AS BIGINT) AS tasks_assigned FROM analysts a LEFT JOIN per USING (analyst)), "
    "tot AS (SELECT CAST(sum(tasks_assigned) AS BIGINT) AS t FROM body)\n"
    f"SELECT analyst, tasks_assigned, CAST(coalesce({pct_sql('tasks_assigned', 't')}, 0.0) AS VARCHAR) || '%' "
    "AS percentage FROM body, tot UNION ALL SELECT 'Total', t, '100.0%' FROM tot"))
def _write_summary(s, d):
    path = scratch_path(s, "assignments")
    writers.write_assignments(_applied(s, d)[1], NAMES, path)
    return s.read.parquet(f"{path}/summary").drop("assigned_retailers")


SHEET_SQL = ("SELECT '' AS \"Date\", category AS \"Category\", list_id AS \"List ID\", list_name AS \"List Name\", "
             "ali AS \"ALI\", '' AS \"Polygon Status\", store_name AS \"Store Name\", address AS \"Address\", "
             "city AS \"City\", state AS \"State\", zip AS \"ZIP\", '' AS \"Source-1\", '' AS \"Source-2\", "
             "'' AS \"Remark\", analyst FROM assigned")
register("analyst_sheets", WP(SPLIT_ROWS_SQL + "\n" + SHEET_SQL))(
    lambda s, d: a.analyst_sheets(_applied(s, d)[1]))

ASSIGNED_COUNTS_SQL = (
    ", got AS (SELECT analyst, sum(v) AS v FROM ("
    f"SELECT p.target AS analyst, r.cnt AS v FROM retailers r JOIN plan p USING (list_name) WHERE p.target IN {IN_NAMES} "
    "UNION ALL SELECT sp.analyst, sp.n FROM retailers r JOIN plan p USING (list_name) "
    f"JOIN split_plan sp USING (list_name) WHERE p.target = 'Split' AND sp.analyst IN {IN_NAMES}) GROUP BY analyst),\n"
    "ac AS (SELECT a.analyst, CAST(coalesce(got.v, 0) AS BIGINT) AS assigned FROM analysts a "
    "LEFT JOIN got USING (analyst))")


def _assigned_counts(s, d):
    t, p, sp = _plan_inputs(s, d)
    return t, a.assigned_counts(q.records_per_retailer(t), NAMES, p, sp)


register("assigned_counts", WP(ASSIGNED_COUNTS_SQL + "\nSELECT * FROM ac"))(
    lambda s, d: _assigned_counts(s, d)[1])


@register("balance_status", WP(
    ASSIGNED_COUNTS_SQL + f", tg AS (SELECT count(*) // {N} AS target FROM tasks)\n"
    "SELECT ac.analyst, ac.assigned, tg.target, CASE WHEN tg.target <= 0 THEN 'neutral' "
    "WHEN ac.assigned > tg.target THEN 'over' WHEN ac.assigned = tg.target THEN 'onTarget' "
    "WHEN ac.assigned >= tg.target * 0.85::DOUBLE THEN 'near' ELSE 'filling' END AS status, "
    "CASE WHEN tg.target > 0 THEN least(ac.assigned / tg.target * 100, 100.0) ELSE 0.0 END AS bar_pct "
    "FROM ac, tg"))
def _balance(s, d):
    t, counts = _assigned_counts(s, d)
    return a.balance_status(counts, a.split_target(t, N))


@register("plan_problems", WB(
    "SELECT 'unassigned_retailer' AS problem, r.list_name, CAST(NULL AS VARCHAR) AS analyst, "
    "r.cnt AS expected, CAST(NULL AS BIGINT) AS actual FROM retailers r "
    "WHERE r.list_name NOT IN (SELECT list_name FROM bad_plan WHERE target IS NOT NULL) "
    "UNION ALL SELECT 'split_sum_mismatch', r.list_name, NULL, r.cnt, CAST(coalesce(s.actual, 0) AS BIGINT) "
    "FROM retailers r JOIN bad_plan p ON p.list_name = r.list_name AND p.target = 'Split' "
    "LEFT JOIN (SELECT list_name, sum(n) AS actual FROM bad_split_plan GROUP BY list_name) s "
    "ON s.list_name = r.list_name WHERE coalesce(s.actual, 0) <> r.cnt "
    "UNION ALL SELECT 'unknown_analyst', list_name, target, NULL, NULL FROM bad_plan "
    f"WHERE target IS NOT NULL AND target <> 'Split' AND target NOT IN {IN_NAMES} "
    "UNION ALL SELECT 'unknown_analyst', s.list_name, s.analyst, NULL, NULL FROM bad_split_plan s "
    "WHERE s.list_name IN (SELECT list_name FROM bad_plan WHERE target = 'Split') "
    f"AND s.analyst NOT IN {IN_NAMES}"))
def _plan_problems(s, d):
    t = tasks(s, d)
    bp, bsp = fx.bad_plan(s, t)
    return a.plan_problems(q.records_per_retailer(t), NAMES, bp, bsp)


# -- sources, sinks, views ------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from taskgrid.config import NA_TOKENS  # noqa: E402
from taskgrid.operators import view  # noqa: E402
from taskgrid.session import scratch_path  # noqa: E402
from taskgrid.sinks import writers  # noqa: E402
from taskgrid.sources import files, schema  # noqa: E402

STRING_COLS = ("category", "list_name", "polygon_status", "store_name", "address", "city", "state", "zip",
               "geo_accuracy", "construction_flag", "batch")
NA_SQL = "(" + ", ".join(f"'{t}'" for t in NA_TOKENS) + ")"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {NA_SQL} THEN NULL ELSE {c} END AS {c}"


def _roundtrip_cols(overrides: dict[str, str] | None = None) -> str:
    overrides = overrides or {}
    return ", ".join(overrides.get(c, _na(c) if c in STRING_COLS else c) for c in TASK_COLS)


@register("read_tasks_csv", W(f"SELECT {_roundtrip_cols()} FROM tasks"))
def _read_csv(s, d):
    path = scratch_path(s, "tasks-csv")
    writers.write_table(tasks(s, d), path, fmt="csv")
    return files.read_tasks_csv(s, path)


@register("union_sheets", W(
    "SELECT " + _roundtrip_cols({"zip": f"CASE WHEN batch = 'A' THEN NULL WHEN zip IN {NA_SQL} THEN NULL "
                                       "ELSE zip END AS zip"})
    + ", CASE WHEN batch = 'N' THEN 'batch ' || batch END AS remark FROM tasks"))
def _union_sheets(s, d):
    t = tasks(s, d)
    base = scratch_path(s, "sheets")
    first = t.filter(F.col("batch") == "A").drop("zip")
    second = t.filter(F.col("batch") == "N").withColumn("remark", F.concat(F.lit("batch "), F.col("batch")))
    third = (t.filter(F.col("batch") == "R")
              .withColumn("polygon_status", F.coalesce(
                  F.col("polygon_status"), F.when(F.col("list_id") % 2 == 0, "N/A").otherwise("null")))
              .select(*reversed(t.columns)))
    paths = []
    for i, sheet in enumerate((first, second, third)):
        p = f"{base}/sheet{i + 1}"
        writers.write_table(sheet, p, fmt="csv")
        paths.append(p)
    return files.union_sheets(s, paths)


# Lines of four fields with some that do not parse: by list_id % 9 a field too many (1) or too few (2), an ALI with a
# letter (3), a latitude that is a word (4), an ALI with a fraction (5).
BAD_LINE_SQL = (
    "category || ',' || list_id || ',' || CASE list_id % 9 WHEN 3 THEN coalesce(ali || 'x', '') "
    "WHEN 5 THEN coalesce(ali || '.5', '') ELSE coalesce(CAST(ali AS VARCHAR), '') END || "
    "CASE list_id % 9 WHEN 1 THEN ',' || latitude || ',extra' WHEN 2 THEN '' WHEN 4 THEN ',oops' ELSE ',' || latitude END")


@register("read_tasks_csv_rejects", W(
    f", b AS (SELECT *, {BAD_LINE_SQL} AS line FROM tasks)\n"
    "SELECT CAST(NULL AS VARCHAR) AS column_name, line AS value, 'wrong number of fields' AS reason FROM b "
    "WHERE list_id % 9 IN (1, 2) UNION ALL SELECT 'ali', ali || 'x', 'not a bigint' FROM b "
    "WHERE list_id % 9 = 3 AND ali IS NOT NULL UNION ALL SELECT 'ali', ali || '.5', 'not a bigint' FROM b "
    "WHERE list_id % 9 = 5 AND ali IS NOT NULL UNION ALL SELECT 'latitude', 'oops', 'not a double' FROM b "
    "WHERE list_id % 9 = 4"))
def _read_rejects(s, d):
    m, text = F.col("list_id") % 9, lambda c: F.coalesce(c, F.lit(""))
    ali, lat = F.col("ali").cast("string"), F.concat(F.lit(","), F.col("latitude").cast("string"))
    line = F.concat(
        "category", F.lit(","), F.col("list_id").cast("string"), F.lit(","),
        F.when(m == 3, text(F.concat(ali, F.lit("x")))).when(m == 5, text(F.concat(ali, F.lit(".5")))).otherwise(text(ali)),
        F.when(m == 1, F.concat(lat, F.lit(",extra"))).when(m == 2, "").when(m == 4, ",oops").otherwise(lat))
    path = scratch_path(s, "bad-csv")
    # whole lines: one column that is never quoted, under a header of four names
    (tasks(s, d).select(line.alias("category,list_id,ali,latitude")).write.option("header", True)
     .option("sep", "\u0001").option("quote", "").csv(path))
    return files.read_checked(s, path).rejects.drop("file")


def _typed_sheets(s, d):
    """Three sheets whose columns hold values of different types."""
    t, lid = tasks(s, d), F.col("list_id")
    text = lambda c: c.cast("string")
    is_open = F.when(lid % 2 == 0, "True").otherwise("False").alias("open")
    sheets = (
        t.filter("batch = 'A'").select("ali", "list_name", text(lid % 7).alias("floor"), text(lid % 100).alias("code"),
                                       F.concat(F.lit("2024-01-"), F.lpad(text(1 + lid % 28), 2, "0")).alias("day"), is_open),
        t.filter("batch = 'N'").select("list_name", "ali", F.concat(text(lid % 7), F.lit(".5")).alias("floor"),
                                       F.concat(F.lit("c"), text(lid % 100)).alias("code"), is_open),
        t.filter("batch = 'R'").select("ali", "list_name", F.lit("N/A").alias("floor"), F.concat(
            F.lit("2024-02-01 10:"), F.lpad(text(lid % 60), 2, "0"), F.lit(":00")).alias("day"), is_open))
    paths = [scratch_path(s, f"typed-sheet{k}") for k in range(len(sheets))]
    for sheet, path in zip(sheets, paths):
        writers.write_table(sheet, path, fmt="csv")
    return paths


@register("union_sheets_inferred", W(
    "SELECT ali, list_name, CASE batch WHEN 'A' THEN CAST(list_id % 7 AS DOUBLE) WHEN 'N' THEN list_id % 7 + 0.5::DOUBLE END "
    "AS floor, CASE batch WHEN 'A' THEN CAST(list_id % 100 AS VARCHAR) WHEN 'N' THEN 'c' || (list_id % 100) END AS code, "
    "CASE batch WHEN 'A' THEN '2024-01-' || lpad(CAST(1 + list_id % 28 AS VARCHAR), 2, '0') || ' 00:00:00' "
    "WHEN 'R' THEN '2024-02-01 10:' || lpad(CAST(list_id % 60 AS VARCHAR), 2, '0') || ':00' END AS day, "
    "list_id % 2 = 0 AS open FROM tasks"))
def _union_inferred(s, d):
    df = files.union_sheets(s, _typed_sheets(s, d), infer=True)
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))


@register("inferred_types", W(
    "SELECT 'floor' AS column_name, 'double' AS type, count(*) AS values FROM tasks WHERE batch IN ('A', 'N') "
    "UNION ALL SELECT 'code', 'string', count(*) FROM tasks WHERE batch IN ('A', 'N') "
    "UNION ALL SELECT 'day', 'timestamp', count(*) FROM tasks WHERE batch IN ('A', 'R') "
    "UNION ALL SELECT 'open', 'boolean', count(*) FROM tasks UNION ALL SELECT 'ali', 'bigint', count(ali) FROM tasks "
    "UNION ALL SELECT 'list_name', 'string', count(list_name) FROM tasks"))
def _inferred_types(s, d):
    return files.inferred_types(files.union_sheets(s, _typed_sheets(s, d), types=None))


DISPLAY_SQL = ", ".join(
    f'{c} AS "{schema.DEFAULT.display(c)}"' for c in TASK_COLS)
register("rename_columns", W(f"SELECT {DISPLAY_SQL} FROM tasks"))(
    lambda s, d: schema.to_display(tasks(s, d)))

_CHECK_ROWS = ([(c, "upload") for c in schema.DEFAULT.required]
               + [(c, "analyser") for c in ("geo_accuracy", "parent_ali")])
_LAYOUT_SET = set(LAYOUT)
register("input_check", W(
    ", probe AS (SELECT count(*) > 0 AS has_rows FROM (SELECT 1 FROM tasks LIMIT 1))\n"
    "SELECT v.column_name, v.required_by, v.present, probe.has_rows FROM (VALUES "
    + ", ".join(f"('{c}', '{by}', {str(c in _LAYOUT_SET).lower()})" for c, by in _CHECK_ROWS)
    + ") AS v(column_name, required_by, present), probe"))(
    # checked on the comparison layout, which lacks most required columns; one row is looked for, so the table is not
    # stored first
    lambda s, d: schema.input_check(schema.available_columns(fx.derive_tasks(s, d))))
register("available_columns", W("SELECT " + ", ".join(LAYOUT) + " FROM tasks"))(
    lambda s, d: schema.available_columns(tasks(s, d)))


@register("write_table", W("SELECT * FROM tasks"))
def _write_table(s, d):
    path = scratch_path(s, "table")
    writers.write_table(tasks(s, d), path, fmt="parquet", display_names=True)
    return schema.from_display(s.read.parquet(path))


@register("write_assignments", WP(SPLIT_ROWS_SQL + "\n" + SHEET_SQL))
def _write_assignments(s, d):
    asg = _applied(s, d)[1]
    path = scratch_path(s, "assignments")
    writers.write_assignments(asg, NAMES, path)
    return s.read.parquet(f"{path}/sheets")


register("json_records", W(
    "SELECT to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in TASK_COLS) + ")) AS record FROM tasks"))(
    lambda s, d: writers.json_records(tasks(s, d)))
register("page", W(
    "SELECT * FROM tasks ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in TASK_COLS)
    + " LIMIT 50 OFFSET 100"))(lambda s, d: view.page(tasks(s, d), 2))


@register("page_deep", W(
    "SELECT * FROM tasks ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in TASK_COLS)
    + " LIMIT 50 OFFSET (SELECT count(*) // 100 * 50 FROM tasks)"))
def _page_deep(s, d):
    t = tasks(s, d)
    middle = view.page_count(t).first()["rows"] // 100
    return view.page(t, middle, shallow=1000)


register("json_intervals", W(
    "SELECT '{\"ali\":' || coalesce(CAST(ali AS VARCHAR), 'null') || ',\"waited\":\"' || "
    "CASE WHEN list_id % 2 = 0 THEN CAST(list_id % 5 AS VARCHAR) ELSE '-' || (list_id % 5 + 1) END || ' days ' || "
    "CASE WHEN list_id % 2 = 0 THEN '01:02:' || lpad(CAST(list_id % 60 AS VARCHAR), 2, '0') "
    "ELSE '+01:02:' || lpad(CAST(list_id % 60 AS VARCHAR), 2, '0') || '.250000' END || '\"}' AS record FROM tasks"))(
    lambda s, d: writers.json_records(tasks(s, d).select("ali", F.when(
        F.col("list_id") % 2 == 0, F.make_dt_interval(F.col("list_id") % 5, F.lit(1), F.lit(2), F.col("list_id") % 60))
        .otherwise(F.make_dt_interval(-(F.col("list_id") % 5 + 1), F.lit(1), F.lit(2), F.col("list_id") % 60 + F.lit(0.25)))
        .alias("waited"))))
register("page_count", W(
    "SELECT count(*) AS rows, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM tasks"))(
    lambda s, d: view.page_count(tasks(s, d)))
