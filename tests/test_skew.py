"""Operators stay exact when one key holds a third of the rows and Spark
splits the skewed partitions (broadcast off, AQE skew-join thresholds low)."""

import random
from collections import Counter

import pytest

from taskgrid.operators import compare as c
from taskgrid.operators import quality as q
from tests.conftest import make_tasks
from tests.test_compare import brute_summary

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _rows(n, hot_ali, hot_addr, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = rng.random()
        ali = hot_ali if r < 0.34 else (None if r < 0.45 else rng.randrange(200))
        addr = hot_addr if rng.random() < 0.34 else rng.choice([None, "a", "b", f"x{i % 50}"])
        out.append({"ali": ali, "address": addr, "list_name": "R",
                    "polygon_status": rng.choice([None, "VerifiedQA", "Draft"])})
    return out


def _skew_joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("SortMergeJoin"), plan.count("isSkew=true") + plan.count("SortMergeJoin(skew=true)")


def test_probe_sides_are_skew_split(skewed):
    d1, d2 = make_tasks(skewed, _rows(900, 7, "hot", 1)), make_tasks(skewed, _rows(600, 7, "hot", 2))
    for df in (c.matched(d1, d2, "ali"), c.only_in_one(d1, d2, "ali"), q.duplicate_ali_rows(d1),
               c.migration_join(d1, d2)):
        smj, split = _skew_joins(df)
        assert smj > 0 and split == smj


def test_joins_exact_under_skew_split(skewed):
    old, new = _rows(900, 7, "hot", 1), _rows(600, 7, "hot", 2)
    d1, d2 = make_tasks(skewed, old), make_tasks(skewed, new)
    new_alis = Counter(r["ali"] for r in new)
    old_alis = Counter(r["ali"] for r in old)
    assert c.matched(d1, d2, "ali").count() == sum(1 for r in old if r["ali"] in new_alis)
    one = c.only_in_one(d1, d2, "ali").collect()
    expect = [r for r in old if r["ali"] not in new_alis] + [r for r in new if r["ali"] not in old_alis]
    assert len(one) == len(expect)
    assert c.unmatched_duplicate_count(d1, d2, "ali").first()[0] == \
        len(expect) - len({r["ali"] for r in expect})
    got = {r.bucket: r.row_count for r in c.migration_summary(d1, d2).collect()}
    assert got == brute_summary(old, new)
    assert c.migration_join(d1, d2).count() == sum(got.values())
    dups = Counter(r["ali"] for r in old)
    assert q.duplicate_ali_rows(d1).count() == sum(n for n in dups.values() if n > 1)


def _launch_rows():
    rng = random.Random(5)
    return [{"list_name": "hot" if rng.random() < 0.4 else f"R{i % 6}", "ali": i, "store_name": f"s{i % 50}",
             "geo_accuracy": rng.choice([None, "x"])} for i in range(4000)]


def test_splits_spread_a_hot_retailer_without_broadcasts(skewed):
    from taskgrid.operators import assign as a
    from tests.test_assign import brute_split, got
    rows = _launch_rows()
    n = Counter(r["list_name"] for r in rows)
    df = make_tasks(skewed, rows).repartition(6)
    plan = {"hot": "Split", "R0": "Ann", "R1": "Split", "R2": "Bo"}
    split = {"hot": {"Ann": 600, "Bo": n["hot"] - 600}, "R1": {"Bo": 10, "Ann": n["R1"] - 10}}
    res = a.apply_plan(df, ["Ann", "Bo"], plan, split)
    assert got(res) == brute_split(rows, {"hot": list(split["hot"].items()), "R1": list(split["R1"].items()),
                                          "R0": [("Ann", n["R0"])], "R2": [("Bo", n["R2"])]})
    whole = a.apply_plan(df, ["Ann", "Bo"], {"hot": "Ann", "R1": "Bo"})
    assert Counter(r.analyst for r in whole.collect()) == {"Ann": n["hot"], "Bo": n["R1"]}
    # the join that labels rows is on (retailer, bucket): the hot retailer has as many keys as buckets
    plan_text = res._jdf.queryExecution().optimizedPlan().toString()
    assert "_mb" in plan_text and "BroadcastNestedLoopJoin" not in res._jdf.queryExecution().executedPlan().toString()
    from taskgrid.operators import slicing
    x = slicing.with_buckets(df, df["list_name"], 2, df.columns)
    assert x.filter("list_name = 'hot'").select("_b").distinct().count() > 200


def test_launch_and_workbook_under_skew(skewed, tmp_dir):
    from pyspark.sql import functions as F
    from taskgrid.sinks import writers
    rows = _launch_rows()
    df = make_tasks(skewed, rows).repartition(6)
    names = skewed.createDataFrame([("hot",), ("R3",)], "name string")
    subset = q.launch_subset(df, selected=names)
    smj, split = _skew_joins(subset)
    assert smj == split == 1
    assert subset.count() == sum(1 for r in rows if r["list_name"] in ("hot", "R3") and r["geo_accuracy"] != "v")
    asg = df.withColumn("analyst", F.when(F.col("list_name") == "hot", "Ann").otherwise("Bo"))
    writers.write_assignments(asg, ["Ann", "Bo"], f"{tmp_dir}/k2")
    import glob
    assert len(glob.glob(f"{tmp_dir}/k2/sheets/analyst=Ann/*.parquet")) > 1
    n = Counter(r["list_name"] == "hot" for r in rows)
    got = {r.analyst: r.tasks_assigned for r in skewed.read.parquet(f"{tmp_dir}/k2/summary").collect()}
    assert got == {"Ann": n[True], "Bo": n[False], "Total": len(rows)}


@pytest.mark.parametrize("mode", ["match", "separate"])
def test_pairs_of_a_heavy_address_are_built_by_many_tasks(skewed, monkeypatch, mode):
    from pyspark.sql import functions as F
    monkeypatch.setattr(c, "BLOCK", 30, raising=False)
    rng = random.Random(3)

    def rows(n):
        return [{"address": rng.choice([None, "hot", "hot", f"x{i}"]), "ali": rng.choice([None, 1, 2, 3]), "zip": str(i),
                 "list_name": "R", "polygon_status": rng.choice([None, "VerifiedQA", "Draft"])} for i in range(n)]
    old, new = rows(700), rows(500)
    d1, d2 = make_tasks(skewed, old), make_tasks(skewed, new)
    want = brute_summary(old, new, mode == "match")
    for bucket in ("changed_lost", "changed_never", "lost_only", "clean"):
        assert c.migration_bucket(d1, d2, bucket, null_keys=mode).count() == want[bucket]
    joined = c.migration_join(d1, d2, null_keys=mode)
    assert joined.count() == sum(want.values())
    assert joined.filter("side = 'both'").select("address", "zip_old", "zip_new").distinct().count() == sum(
        (o["address"] == n["address"]) and (mode == "match" or n["address"] is not None) for o in old for n in new)
    shares = [r["count"] for r in joined.filter("side = 'both'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 0.5 * sum(shares)
