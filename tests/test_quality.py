"""Analyser: truth tables, invariants, edge inputs."""

import itertools

import pytest
from pyspark.sql import functions as F

from taskgrid.operators import quality as q
from taskgrid.plans import registry
from tests.conftest import SF001, make_tasks

STATUSES = [None, "None", "Draft", "VerifiedQA", "VerifiedAdmin", "Rejected"]
FLAGS = [None, "Normal", "Construction", "Mall Tenant", "Multi-Level", "Kiosk"]
GEOS = [None, "AGGDATA_VERIFIED: ROOFTOP", "STREET ADDRESS: ROOFTOP"]
VERIFIED = {"RETAILSTAT VERIFIED: ROOFTOP", "AGGDATA_VERIFIED: ROOFTOP"}


def brute_class(status, flag, geo):
    s = "None" if status is None else status
    f = "Normal" if flag is None else flag
    g = geo in VERIFIED
    marked = s in ("VerifiedQA", "VerifiedAdmin") or f in ("Mall Tenant", "Multi-Level") or \
        (s in ("None", "Draft") and f == "Normal" and g)
    pending = s in ("None", "Draft") and (f == "Construction" or (f == "Normal" and not g))
    assert not (marked and pending)
    return "marked" if marked else "pending" if pending else "neither"


@pytest.fixture(scope="module")
def truth(spark):
    rows = [{"ali": i, "list_name": "R", "polygon_status": s, "construction_flag": f, "geo_accuracy": g}
            for i, (s, f, g) in enumerate(itertools.product(STATUSES, FLAGS, GEOS))]
    return rows, make_tasks(spark, rows)


def test_classification_truth_table(truth):
    rows, df = truth
    assert len(rows) == 108
    got = {r.ali: r.coverage for r in q.classify_marked(df).collect()}
    for i, r in enumerate(rows):
        assert got[i] == brute_class(r["polygon_status"], r["construction_flag"], r["geo_accuracy"]), r


def test_coverage_and_qc_against_brute_force(truth):
    rows, df = truth
    cov = q.polygon_coverage(df).first()
    classes = [brute_class(r["polygon_status"], r["construction_flag"], r["geo_accuracy"]) for r in rows]
    assert cov.total == 108
    assert cov.marked_count == classes.count("marked")
    assert cov.pending_count == classes.count("pending")
    assert cov.polygon_done_count == sum(r["polygon_status"] in ("VerifiedQA", "VerifiedAdmin") for r in rows)
    qc = q.qc_error_totals(df).first()
    mt = sum(r["construction_flag"] == "Mall Tenant" and r["polygon_status"] is not None for r in rows)
    co = sum(r["construction_flag"] == "Construction" and
             (r["polygon_status"] is not None or r["geo_accuracy"] in VERIFIED) for r in rows)
    assert (qc.mall_tenant_errors, qc.construction_errors) == (mt, co)
    assert qc.total_errors == qc.mall_tenant_errors + qc.multi_level_errors + qc.construction_errors


def test_fixture_coverage_numbers(spark):
    cov = registry.QUERIES["polygon_coverage"](spark, SF001).first()
    assert (cov.total, cov.marked_count, cov.pending_count) == (6000, 3853, 1535)


def test_marked_and_pending_disjoint(spark):
    t = registry.tasks(spark, SF001)
    both = t.filter(q.marked_condition() & q.pending_condition()).count()
    assert both == 0


def test_pivot_total_equals_rows(spark):
    t = registry.tasks(spark, SF001)
    b = q.construction_flag_breakdown(t)                         # discovery mode
    labels = [c for c in b.columns if c not in ("list_name", "Total")]
    assert "Kiosk" in labels and "Normal" in labels
    s = b.agg(F.sum("Total"), *[F.sum(F.col(f"`{x}`")) for x in labels]).first()
    assert s[0] == t.filter("list_name IS NOT NULL").count() == sum(s[1:])


def test_pivot_label_total_rejected(spark):
    df = make_tasks(spark, [{"list_name": "A", "construction_flag": "Total"}])
    with pytest.raises(ValueError):
        q.construction_flag_breakdown(df)


def test_labels_beyond_the_list_fail_wide_and_show_long(spark):
    df = make_tasks(spark, [{"list_name": "A", "construction_flag": f} for f in ("Normal", "normal", None, "New")])
    with pytest.raises(Exception, match="beyond the listed columns"):
        q.construction_flag_breakdown(df, values=["Normal"]).count()
    got = sorted(tuple(r) for r in q.construction_flag_long(df).collect())
    assert got == [("A", "New", 1), ("A", "Normal", 2), ("A", "normal", 1)]


def test_full_row_matches_parts(spark):
    t = registry.tasks(spark, SF001)
    row = q.full_analysis_row(t).first()
    cov = q.polygon_coverage(t).first()
    dup = q.duplicate_ali_summary(t).first()
    assert row.total_records == cov.total == dup.total
    assert (row.marked_count, row.pending_count, row.marked_pct) == \
        (cov.marked_count, cov.pending_count, cov.marked_pct)
    assert (row.unique_ali, row.duplicate_count) == (dup.unique_ali, dup.duplicate_count)


def test_empty_table(spark):
    df = make_tasks(spark, [])
    cov = q.polygon_coverage(df).first()
    assert cov.total == 0 and cov.marked_pct is None
    assert q.records_per_retailer(df).count() == 0
    assert q.full_analysis_row(df).first().total_records == 0
    assert [r["count"] for r in q.construction_flag_percentages(df).collect()] == [0, 0, 0, 0]


def test_needs_work_and_launch_subset(spark):
    df = make_tasks(spark, [
        {"list_name": "A", "geo_accuracy": None}, {"list_name": "A", "geo_accuracy": "AGGDATA_VERIFIED: ROOFTOP"},
        {"list_name": "B", "geo_accuracy": "PREMISE: ROOFTOP"}, {"list_name": "C", "geo_accuracy": "AGGDATA_VERIFIED: ROOFTOP"},
        {"list_name": None, "geo_accuracy": None}])
    assert q.needs_work(df).count() == 3
    prev = [tuple(r) for r in q.needs_work_preview(df).collect()]
    assert prev == [("A", 1), ("B", 1), ("C", 0)]
    assert q.launch_subset(df, selected=["B"]).count() == 1
    assert q.launch_subset(df, selected=[f"X{i}" for i in range(1500)] + ["A"]).count() == 1
    summary = q.launch_summary(q.launch_subset(df, selected=["A"])).first()
    assert (summary.mode, summary.total_alis) == ("single", 1)


def test_launch_subset_takes_any_number_of_names(spark):
    from taskgrid.operators import quality
    df = make_tasks(spark, [{"ali": 1, "list_name": "n5"}, {"ali": 2, "list_name": "other"}])
    assert quality.launch_subset(df, selected=[f"n{i}" for i in range(100_001)]).count() == \
        quality.launch_subset(df, selected=["n5"]).count()
    assert quality.launch_summary(df.limit(0)).first().mode is None
