"""Plan properties: filters reach the scan, columns are pruned, and no
registered query plans a cartesian product or a nested-loop join."""

import re

import pytest

from taskgrid.plans import registry
from tests.conftest import SF001

WRITES_FIRST = {"read_tasks_csv", "union_sheets", "write_table", "write_assignments"}


def _plan(spark, key):
    df = registry.QUERIES[key](spark, SF001)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - WRITES_FIRST))
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(spark, key)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython", plan)   # no Python in the hot path


@pytest.mark.parametrize("key,pushed", [
    ("needs_work", "Or(IsNull(geo_accuracy),Not(In(geo_accuracy"),
    ("qc_mall_tenant_errors", "EqualTo(construction_flag,Mall Tenant)"),
    ("migration_only_old", "In(batch, [A,R])"),
])
def test_filters_reach_the_scan(spark, key, pushed):
    scans = re.findall(r"PushedFilters: \[(.*?), ReadSchema", _plan(spark, key))
    assert any(pushed in s for s in scans), scans


@pytest.mark.parametrize("key,columns", [("full_analysis", 6), ("polygon_coverage", 3),
                                         ("construction_flag_percentages", 1), ("page_count", 0)])
def test_columns_are_pruned(spark, key, columns):
    reads = re.findall(r"FileScan parquet \[([^\]]*)\]", _plan(spark, key))
    assert reads and all(len([c for c in r.split(",") if c.strip()]) <= columns for r in reads)


@pytest.fixture()
def tiny_broadcasts(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in old:
        spark.conf.set(k, "1")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_splits_shuffle_edge_rows_only(tiny_broadcasts):
    from collections import Counter

    from taskgrid.operators import assign as a
    from tests.conftest import make_tasks
    df = make_tasks(tiny_broadcasts, [{"list_name": f"R{i % 3}", "ali": i, "zip": str(i)} for i in range(3000)])
    splits = (a.equal_split(df, ["Ann", "Bo"]),
              a.apply_plan(df, ["Ann", "Bo"], {"R0": "Ann", "R1": "Split"}, {"R1": {"Ann": 300, "Bo": 700}}))
    for res, want in zip(splits, ({"Ann": 1500, "Bo": 1500}, {"Ann": 1300, "Bo": 700})):
        assert Counter(r.analyst for r in res.collect()) == want
        plan = res._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # no join of task rows with the bucket map is a shuffled one
        assert not re.search(r"SortMergeJoin(\(skew=true\))? \[_g#\d+, _b#", plan)


def test_fixture_shuffles_no_wide_rows(tiny_broadcasts):
    from taskgrid.sources import fixtures as fx
    plan = fx.derive_tasks(tiny_broadcasts, SF001)._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"Join \[(l_\w+)#", plan)
    assert joins == ["l_partkey", "l_suppkey"]  # the texts of parts come last, above them is no shuffle


def test_fixture_is_stored_as_the_last_join_leaves_it(spark, monkeypatch):
    from taskgrid.sources import fixtures as fx
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.hint", _no_rebalance)
    assert fx.tasks.__wrapped__(spark, SF001).count() == 6000


def _no_rebalance(self, name, *parameters, _hint=None):
    assert name != "rebalance"
    return type(self)(self._jdf.hint(name, self._jseq(parameters)), self.sparkSession)


def test_input_check_does_not_store_the_table(spark, monkeypatch):
    from taskgrid.sources import fixtures as fx

    def stored(*_):
        raise AssertionError("the table is stored for a check of one row")
    monkeypatch.setattr(fx, "tasks", stored)
    assert registry.QUERIES["input_check"](spark, SF001).filter("has_rows").count() == 12
