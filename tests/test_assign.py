"""Launcher: splits against brute force, invariants, plans, edge inputs."""

import hashlib
from collections import Counter

import pytest

from taskgrid.operators import assign as a
from taskgrid.operators import quality as q
from taskgrid.operators import slicing
from taskgrid.plans import registry
from tests.conftest import SF001, TASK_COLUMNS, make_tasks


def _text(v):
    if v is None:
        return "-"
    return repr(v) if isinstance(v, float) else str(v)


def _part(v):
    return "-" if v is None else f"{len(_text(v))}:{_text(v)}"


def _h(row, seed=0):
    return hashlib.md5("|".join([str(seed)] + [_part(row.get(c)) for c in TASK_COLUMNS]).encode()).hexdigest()


def brute_equal(rows, names, seed=0):
    order = sorted(rows, key=lambda r: _h(r, seed))
    n = len(names)
    target, rem = divmod(len(rows), n)
    out = Counter()
    for rank, r in enumerate(order):
        i = 0 if target == 0 or rank < target + rem else (rank - rem) // target
        out[(tuple(r.get(c) for c in TASK_COLUMNS), names[i])] += 1
    return out


def brute_split(rows, plan, seed=0):
    """plan: {retailer: [(analyst, n), ...]}"""
    out = Counter()
    for ret, shares in plan.items():
        order = sorted([r for r in rows if r.get("list_name") == ret], key=lambda r: _h(r, seed))
        i = 0
        for name, n in shares:
            for r in order[i:i + n]:
                out[(tuple(r.get(c) for c in TASK_COLUMNS), name)] += 1
            i += n
    return out


def got(df):
    return Counter((tuple(r[c] for c in TASK_COLUMNS), r["analyst"]) for r in df.collect())


def sample_rows(n_distinct=400, copies=200):
    rows = [{"list_name": f"R{i % 3}", "ali": i, "address": f"{i} Main", "latitude": float(i % 7) - 3.0,
             "polygon_status": None if i % 4 else "Draft"} for i in range(n_distinct)]
    rows += [{"list_name": "R0", "ali": 99999, "address": "copy"}] * copies
    return rows


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_equal_split_matches_brute_force(spark, digits, monkeypatch):
    monkeypatch.setattr(slicing, "CHUNK", 7)   # force copies to span several chunks
    rows = sample_rows()
    names = ["Ann", "Bo", "Cy", "Di"]
    res = a.equal_split(make_tasks(spark, rows), names, digits=digits)
    assert got(res) == brute_equal(rows, names)
    sizes = Counter(r.analyst for r in res.collect())
    target, rem = divmod(len(rows), 4)
    assert sizes == {"Ann": target + rem, "Bo": target, "Cy": target, "Di": target}


def test_equal_split_same_at_any_partitioning(spark):
    rows = sample_rows(300, 50)
    df = make_tasks(spark, rows)
    names = ["x", "y", "z"]
    a1 = got(a.equal_split(df.repartition(7), names, seed=3))
    a2 = got(a.equal_split(df.coalesce(1), names, seed=3))
    assert a1 == a2 == brute_equal(rows, names, seed=3)
    assert got(a.equal_split(df, names, seed=4)) != a1


def test_more_analysts_than_rows(spark):
    rows = sample_rows(2, 0)
    res = a.equal_split(make_tasks(spark, rows), ["a", "b", "c", "d", "e"])
    assert Counter(r.analyst for r in res.collect()) == {"a": 2}


def test_duplicate_analysts_rejected(spark):
    with pytest.raises(ValueError):
        a.equal_split(make_tasks(spark, sample_rows(3, 0)), ["a", "a"])


def test_split_by_counts_and_errors(spark, monkeypatch):
    monkeypatch.setattr(slicing, "CHUNK", 5)
    rows = sample_rows(90, 40)
    df = make_tasks(spark, rows)
    counts = Counter(r["list_name"] for r in rows)
    plan = {"R0": [("p", 30), ("q", counts["R0"] - 30)], "R1": [("q", counts["R1"])]}
    res = a.split_by_counts(df, {k: dict(v) for k, v in plan.items()}, ["p", "q"], digits=1)
    assert got(res) == brute_split(rows, plan)
    one = a.fixed_count_split(df, "R2", {"p": 10, "q": counts["R2"] - 10})
    assert Counter(r.analyst for r in one.collect()) == {"p": 10, "q": counts["R2"] - 10}
    with pytest.raises(ValueError, match="sum to"):
        a.fixed_count_split(df, "R2", {"p": 1})
    with pytest.raises(ValueError, match="not"):
        a.split_by_counts(df, {"R2": {"zed": counts["R2"]}}, ["p", "q"])


def test_apply_plan_rules(spark):
    rows = sample_rows(60, 0) + [{"list_name": "R9", "ali": 1}, {"list_name": None, "ali": 2}]
    df = make_tasks(spark, rows)
    counts = Counter(r["list_name"] for r in rows)
    plan = {"R0": "Ann", "R1": "Split", "R2": "Nobody", "ghost": "Ann"}   # R9 missing, R2 unknown
    split = {"R1": {"Bo": 5, "Ann": counts["R1"] - 5}}
    res = a.apply_plan(df, ["Ann", "Bo"], plan, split)
    assert Counter(r.analyst for r in res.collect()) == {"Ann": counts["R0"] + counts["R1"] - 5, "Bo": 5}
    assert got(res) == brute_split(rows, {"R0": [("Ann", counts["R0"])],
                                          "R1": [("Bo", 5), ("Ann", counts["R1"] - 5)]})
    with pytest.raises(ValueError, match="has no counts"):
        a.apply_plan(df, ["Ann"], {"R1": "Split"}, {})
    with pytest.raises(ValueError):
        a.apply_plan(df, ["Ann"], {"R1": "Split"}, {"R1": {"Zed": counts["R1"]}})
    dup_plan = spark.createDataFrame([("R0", "Ann"), ("R0", "Bo")], "list_name string, target string")
    with pytest.raises(ValueError, match="more than once"):
        a.apply_plan(df, ["Ann", "Bo"], dup_plan)
    un = a.unassigned_count(df, res).first()[0]
    assigned_alis = {r["ali"] for r in rows if r.get("list_name") in ("R0", "R1")}
    assert un == len({r["ali"] for r in rows} - assigned_alis)


def test_summary_and_sheets(spark):
    rows = sample_rows(30, 0)
    df = make_tasks(spark, rows)
    res = a.apply_plan(df, ["Ann", "Bo", "Cy"], {"R0": "Ann", "R1": "Bo", "R2": "Ann"})
    s = [tuple(r) for r in a.assignment_summary(res, ["Ann", "Bo", "Cy"]).collect()]
    assert s == [("Ann", 20, "66.7%", "R0, R2"), ("Bo", 10, "33.3%", "R1"), ("Cy", 0, "0.0%", ""),
                 ("Total", 30, "100.0%", "")]
    sheet = a.analyst_sheets(res)
    assert sheet.columns[:14] == ["Date", "Category", "List ID", "List Name", "ALI", "Polygon Status",
                                  "Store Name", "Address", "City", "State", "ZIP", "Source-1", "Source-2",
                                  "Remark"]
    first = sheet.filter("ALI = 0").first()
    assert (first["Date"], first["Polygon Status"], first["List Name"], first["Address"]) == ("", "", "R0", "0 Main")
    empty = a.assignment_summary(res.limit(0), ["Ann"]).collect()
    assert [tuple(r) for r in empty] == [("Ann", 0, "0.0%", ""), ("Total", 0, "100.0%", "")]


def test_balance_boundaries(spark):
    assigned = spark.createDataFrame([(f"a{x}", x) for x in (0, 84, 85, 99, 100, 101)], "analyst string, assigned long")
    st = {r.analyst: (r.status, r.bar_pct) for r in a.balance_status(assigned, 100).collect()}
    assert st == {"a0": ("filling", 0.0), "a84": ("filling", 84.0), "a85": ("near", 85.0),
                  "a99": ("near", 99.0), "a100": ("onTarget", 100.0), "a101": ("over", 100.0)}
    zero = {r.status for r in a.balance_status(assigned, 0).collect()}
    assert zero == {"neutral"}


def test_targets_and_modes(spark):
    df = make_tasks(spark, sample_rows(10, 0))
    t = a.split_target(df, 3).first()
    assert (t.total, t.target, t.remainder) == (10, 3, 1)
    with pytest.raises(ValueError):
        a.split_target(df, 0)
    assert a.retailer_mode(df).first().mode == "multi"
    assert a.retailer_mode(df.filter("list_name = 'R1'")).first().mode == "single"
    assert a.retailer_mode(df.limit(0)).first().mode == "multi"


def test_plan_screen_on_fixture(spark):
    t = registry.tasks(spark, SF001)
    counts = q.records_per_retailer(t)
    from taskgrid.sources import fixtures as fx
    p, sp = fx.plan(spark, t), fx.split_plan(spark, t)
    ac = {r.analyst: r.assigned for r in a.assigned_counts(counts, fx.ANALYSTS, p, sp).collect()}
    assert ac == {"Analyst 1": 2091, "Analyst 2": 2209, "Analyst 3": 1576}
    applied = Counter(r.analyst for r in a.apply_plan(t, fx.ANALYSTS, p, sp).collect())
    assert applied == ac
    bp, bsp = fx.bad_plan(spark, t)
    problems = sorted(r.problem for r in a.plan_problems(counts, fx.ANALYSTS, bp, bsp).collect())
    assert problems == ["split_sum_mismatch", "unassigned_retailer", "unknown_analyst"]
    assert a.plan_problems(counts, fx.ANALYSTS, p, sp).count() == 0


def test_different_rows_never_share_a_hash(spark):
    rows = [("R", "A|B", "C"), ("R", "A", "B|C"), ("R", None, "x"), ("R", "\\N", "x"), ("R", "-", "x")]
    df = spark.createDataFrame(rows, "list_name string, a string, b string")
    got = a.equal_split(df, ["p", "q"]).collect()
    assert sorted(map(str, ((r.list_name, r.a, r.b) for r in got))) == sorted(map(str, rows))


def test_analyst_named_twice_in_slices_keeps_every_row_once(spark):
    from taskgrid.operators import slicing
    df = spark.createDataFrame([("R", i) for i in range(300)], "list_name string, ali long")
    x, bc = slicing.bucket_counts(df, "list_name", digits=1)
    cuts = spark.createDataFrame([("R", "Ann", 0, 100), ("R", "Bo", 100, 200), ("R", "Ann", 200, 300)],
                                 "_g string, analyst string, lo long, hi long")
    got = slicing.assign_ranges(x, bc, cuts, df.columns).collect()
    assert sorted(r.ali for r in got) == list(range(300))
    assert sum(r.analyst == "Ann" for r in got) == 200
