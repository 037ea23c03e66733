"""Comparator: truth tables, pair counting under skew, edge inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from taskgrid.operators import compare as c
from taskgrid.plans import registry
from tests.conftest import SF001, make_tasks

ALI_PAIRS = {"equal": (1, 1), "different": (1, 2), "both null": (None, None), "one null": (1, None)}
STATUS_PAIRS = {"null/null": (None, None), "set/null": ("VerifiedQA", None), "null/set": (None, "Draft"),
                "equal": ("VerifiedQA", "VerifiedQA"), "different": ("VerifiedQA", "Draft")}


def brute_bucket(ao, an, so, sn):
    differs = ao is None or an is None or ao != an
    if differs and so is not None and sn is None:
        return "changed_lost"
    if differs and so is None and sn is None:
        return "changed_never"
    if not differs and so is not None and sn is None:
        return "lost_only"
    if not differs and so is not None and sn is not None and so == sn:
        return "clean"
    return "other"


def _pairs(rows_old, rows_new, null_match=True):
    """Brute-force matched pairs on address."""
    out = []
    for o in rows_old:
        for n in rows_new:
            if o["address"] == n["address"] and (o["address"] is not None or null_match):
                out.append((o, n))
    return out


def brute_summary(rows_old, rows_new, null_match=True):
    pairs = _pairs(rows_old, rows_new, null_match)
    counts = {b: 0 for b in c.SUMMARY_BUCKETS}
    for o, n in pairs:
        counts[brute_bucket(o["ali"], n["ali"], o["polygon_status"], n["polygon_status"])] += 1

    def has(rows, a):
        return any(r["address"] == a and (a is not None or null_match) for r in rows)
    counts["only_old"] = sum(not has(rows_new, o["address"]) for o in rows_old)
    counts["only_new"] = sum(not has(rows_old, n["address"]) for n in rows_new)
    return counts


@pytest.fixture(scope="module")
def truth(spark):
    old, new, expect = [], [], {}
    for i, ((ak, (ao, an)), (sk, (so, sn))) in enumerate(itertools.product(ALI_PAIRS.items(), STATUS_PAIRS.items())):
        addr = f"addr{i}"
        old.append({"address": addr, "ali": ao, "polygon_status": so, "list_name": "R"})
        new.append({"address": addr, "ali": an, "polygon_status": sn, "list_name": "R"})
        expect[addr] = brute_bucket(ao, an, so, sn)
    return old, new, expect, make_tasks(spark, old), make_tasks(spark, new)


def test_migration_truth_table(truth):
    old, new, expect, d1, d2 = truth
    assert len(expect) == 20
    for b in ("changed_lost", "changed_never", "lost_only", "clean"):
        got = {r.address for r in c.migration_bucket(d1, d2, b).collect()}
        assert got == {a for a, e in expect.items() if e == b}, b
    summary = {r.bucket: r.row_count for r in c.migration_summary(d1, d2).collect()}
    assert summary == brute_summary(old, new)


def test_summary_without_pairs_under_skew(spark):
    rng = random.Random(7)

    def rows(n, hot):
        out = []
        for _ in range(n):
            addr = hot if rng.random() < 0.5 else rng.choice([None, "a", "b", "c", "d"])
            out.append({"address": addr, "ali": rng.choice([None, 1, 2, 3]),
                        "polygon_status": rng.choice([None, "VerifiedQA", "Draft"]), "list_name": "R"})
        return out
    old, new = rows(120, "hot"), rows(90, "hot")
    d1, d2 = make_tasks(spark, old), make_tasks(spark, new)
    for mode, match in (("match", True), ("separate", False)):
        got = {r.bucket: r.row_count for r in c.migration_summary(d1, d2, null_keys=mode).collect()}
        assert got == brute_summary(old, new, match), mode
        join = c.migration_join(d1, d2, null_keys=mode)
        assert join.count() == sum(got.values())
        sides = {r.side: r["count"] for r in join.groupBy("side").count().collect()}
        assert sides.get("left_only", 0) == got["only_old"]
        assert sides.get("both", 0) == len(_pairs(old, new, match))


def test_only_in_one_flags_duplicates_with_nulls(spark):
    d1 = make_tasks(spark, [{"ali": None}, {"ali": 5}, {"ali": 6}, {"ali": 9}])
    d2 = make_tasks(spark, [{"ali": 5}, {"ali": 7}, {"ali": 7}, {"ali": 6}])
    got = sorted((r.ali or -1, r.source, r.duplicate) for r in c.only_in_one(d1, d2, "ali").collect())
    assert got == [(-1, "File 1", "No"), (7, "File 2", "⚠️ Yes"), (7, "File 2", "⚠️ Yes"), (9, "File 1", "No")]
    assert c.unmatched_duplicate_count(d1, d2, "ali").first()[0] == 1
    assert sorted(r.ali for r in c.matched(d1, d2, "ali").collect()) == [5, 6]
    d3 = make_tasks(spark, [{"ali": None}])
    assert c.matched(d1, d3, "ali").count() == 1                   # null matches null


def test_compare_kinds(spark):
    v1, v2 = registry.v1(spark, SF001), registry.v2(spark, SF001)
    assert set(c.compare(v1, v2, "ALI")) == {"matched", "unmatched", "unmatched_duplicate_count", "conflicts"}
    mig = c.compare(v1, v2, "Migration")
    assert {r.bucket: r.row_count for r in mig["summary"].collect()}["clean"] == mig["clean"].count() == 849
    with pytest.raises(ValueError):
        c.compare(v1, v2, "Zip")


def test_fixture_counts_sf0001(spark):
    v1, v2 = registry.v1(spark, SF001), registry.v2(spark, SF001)
    s = {r.bucket: r.row_count for r in c.migration_summary(v1, v2).collect()}
    assert s == {"changed_lost": 169, "changed_never": 166, "lost_only": 158, "clean": 849,
                 "only_old": 2043, "only_new": 2147, "other": 1157}
    assert c.matched(v1, v2, "ali").count() == 2210


@pytest.mark.parametrize("key", ["ali", "address"])
def test_file_rows_split_into_matched_and_one_sided(spark, key):
    v1, v2 = registry.v1(spark, SF001), registry.v2(spark, SF001)
    one = c.only_in_one(v1, v2, key)
    assert c.matched(v1, v2, key).count() + one.filter("source = 'File 1'").count() == v1.count()
    assert c.matched(v2, v1, key).count() + one.filter("source = 'File 2'").count() == v2.count()


def test_migration_parts_cover_both_files(spark):
    v1, v2 = registry.v1(spark, SF001), registry.v2(spark, SF001)
    j = c.migration_join(v1, v2)
    sides = {r.side: r["count"] for r in j.groupBy("side").count().collect()}
    assert sides["left_only"] == c.migration_only_old(v1, v2).count()
    assert sides["right_only"] == c.migration_only_new(v1, v2).count()
    assert j.filter("side = 'both'").select("list_name_old", "ali_old", "address", "city_old", "zip_old",
                                            "polygon_status_old").distinct().count() <= \
        v1.count() - sides["left_only"]


def test_classes_hold_what_the_pairs_hold(spark):
    import random
    from collections import Counter
    rng = random.Random(12)
    rows = lambda n: [{"address": rng.choice([None, "a", "b", "c", f"x{k % 9}"]), "ali": rng.choice([None, 1, 2, 3]),
                       "list_name": f"L{k % 4}", "polygon_status": rng.choice([None, "VerifiedQA", "Draft"])} for k in range(n)]
    d1, d2 = make_tasks(spark, rows(120)), make_tasks(spark, rows(90))
    for mode in ("match", "separate"):
        classes = c.migration_classes(d1, d2, null_keys=mode).collect()
        for b in ("changed_lost", "changed_never", "lost_only", "clean"):
            want = Counter(r.address for r in c.migration_bucket(d1, d2, b, null_keys=mode).collect())
            assert {r.address: int(r[b]) for r in classes if r[b]} == want
        want = Counter(r.address for r in c.migration_pairs(d1, d2, null_keys=mode).collect())
        assert {r.address: int(r.pairs) for r in classes if r.pairs} == want
        summary = {r.bucket: r.row_count for r in c.migration_summary(d1, d2, null_keys=mode).collect()}
        assert summary["only_old"] == sum(r.old_rows for r in classes if r.side in ("left_only", "apart"))
        assert summary["clean"] == sum(int(r.clean) for r in classes)
    null = [r for r in c.migration_classes(d1, d2).collect() if r.address is None]
    assert [(r.side, int(r.pairs)) for r in null] == [("apart", 0)]
    members = c.migration_members(d1, d2)
    asked = spark.createDataFrame([("a",), (None,), ("a",), ("nowhere",)], "address string")
    pairs = c.pairs_of_classes(members, asked)
    want = c.migration_pairs(d1, d2, null_keys="separate").filter("address = 'a'")
    assert sorted(map(str, pairs.select(sorted(pairs.columns)).collect())) == \
        sorted(map(str, want.select(sorted(want.columns)).collect()))


def test_keys_of_further_types(spark):
    import datetime as dt
    at = [dt.datetime(2024, 1, k) for k in (1, 2, 3)]
    from taskgrid.operators.joins import keyed_semi
    a = spark.createDataFrame([(at[0], b"x"), (None, b""), (at[1], None)], "k timestamp, b binary")
    b = spark.createDataFrame([(at[0], None), (None, b"x")], "k timestamp, b binary")
    assert sorted(str(r.k) for r in keyed_semi(a, b, "k").collect()) == sorted([str(at[0]), "None"])
    assert sorted(str(r.b) for r in keyed_semi(a, b, "b").collect()) == sorted(["None", str(a.first().b)])
    with pytest.raises(TypeError, match="unsupported key type"):
        keyed_semi(a.withColumn("m", F.array("k")), b.withColumn("m", F.array("k")), "m")
