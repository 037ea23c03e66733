"""Edge inputs: all-null retailer, all-null key, single retailer."""

from taskgrid.operators import assign as a
from taskgrid.operators import compare as c
from taskgrid.operators import quality as q
from tests.conftest import make_tasks


def test_all_null_retailer(spark):
    df = make_tasks(spark, [{"ali": i, "list_name": None} for i in range(5)])
    assert q.records_per_retailer(df).count() == 0
    assert [r.list_name for r in q.unique_retailers(df).collect()] == [None]
    assert q.unique_retailers_count(df).first()[0] == 0
    assert a.retailer_mode(df).first().mode == "multi"
    assert q.construction_flag_breakdown(df, values=["Normal"]).count() == 0
    res = a.equal_split(df, ["x", "y"])
    assert sorted(r.analyst for r in res.collect()) == ["x", "x", "x", "y", "y"]
    s = [tuple(r) for r in a.assignment_summary(res, ["x", "y"]).collect()]
    assert s == [("x", 3, "60.0%", ""), ("y", 2, "40.0%", ""), ("Total", 5, "100.0%", "")]


def test_all_null_key(spark):
    d1 = make_tasks(spark, [{"ali": None, "address": f"a{i}"} for i in range(3)])
    d2 = make_tasks(spark, [{"ali": None, "address": f"b{i}"} for i in range(2)])
    assert c.matched(d1, d2, "ali").count() == 3                     # null matches null
    assert c.only_in_one(d1, d2, "ali").count() == 0
    assert c.unmatched_duplicate_count(d1, d2, "ali").first()[0] == 0
    assert c.conflicts(d1, d2, "ali", "address").count() == 0        # null keys excluded
    dup = q.duplicate_ali_summary(d1).first()
    assert (dup.unique_ali, dup.duplicate_count) == (0, 2)
    assert q.duplicate_ali_rows(d1).count() == 3
    e = make_tasks(spark, [{"ali": 1, "address": None}, {"ali": 2, "address": None}])
    f = make_tasks(spark, [{"ali": 3, "address": None}])
    s = {r.bucket: r.row_count for r in c.migration_summary(e, f).collect()}
    assert s["changed_never"] == 2 and s["only_old"] == 0             # null addresses pair
    s2 = {r.bucket: r.row_count for r in c.migration_summary(e, f, null_keys="separate").collect()}
    assert (s2["only_old"], s2["only_new"], s2["changed_never"]) == (2, 1, 0)


def test_single_retailer_split(spark):
    df = make_tasks(spark, [{"ali": i, "list_name": "Solo"} for i in range(10)])
    assert a.retailer_mode(df).first().mode == "single"
    res = a.fixed_count_split(df, "Solo", {"p": 4, "q": 6})
    assert sorted((r.analyst, r.ali) for r in res.collect()) == sorted(
        (r.analyst, r.ali) for r in a.fixed_count_split(df.repartition(3), "Solo", {"p": 4, "q": 6}).collect())
    assert {r.analyst for r in res.collect()} == {"p", "q"}
