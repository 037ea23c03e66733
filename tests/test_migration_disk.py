"""What the migration queries send through shuffles: each file once and the old keys, no keys counted one by one; the
rows of a heavy address a bounded number of times."""

import glob
import random
import time

import pytest
from pyspark.sql import functions as F

from taskgrid.operators import compare as c
from taskgrid.sources import fixtures as fx
from tests.conftest import SF001, make_tasks
from tests.test_compare import brute_summary


def _shuffled_rows(df) -> int:
    """Rows written by the shuffles of ``df``, run to its end; a reused one counts once."""
    df.collect()

    def walk(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        kids = node.children()
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))
    return walk(df._jdf.queryExecution().executedPlan())


def _rows(rng, addresses):
    return [{"address": a, "ali": rng.choice([None, 1, 2, 3]), "zip": str(i), "list_name": "R",
             "polygon_status": rng.choice([None, "VerifiedQA", "Draft"])} for i, a in enumerate(addresses)]


@pytest.fixture()
def large(spark):
    """No join is small enough for a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def test_each_file_is_shuffled_once(large, monkeypatch):
    spark = large
    monkeypatch.setattr(c, "BUCKETS", 8, raising=False)
    rng = random.Random(1)
    old, new = _rows(rng, [f"x{i}" for i in range(800)]), _rows(rng, [f"x{i}" for i in range(400, 1000)])
    join = c.migration_join(make_tasks(spark, old), make_tasks(spark, new))
    want = brute_summary(old, new)
    assert join.count() == sum(want.values())
    assert _shuffled_rows(join) < 1.1 * (800 + 600 + 800)
    lost = c.migration_bucket(make_tasks(spark, old), make_tasks(spark, new), "changed_lost")
    assert lost.count() == want["changed_lost"]
    kept = sum(r["polygon_status"] is not None for r in old) + sum(r["polygon_status"] is None for r in new)
    assert _shuffled_rows(lost) < 1.1 * kept


@pytest.mark.parametrize("mode", ["match", "separate"])
def test_rows_of_a_heavy_address_are_sent_a_bounded_number_of_times(spark, monkeypatch, mode):
    for name, value in (("BLOCK", 1), ("MOST_PARTS", 4), ("TILE", 16), ("BUCKETS", 8)):
        monkeypatch.setattr(c, name, value, raising=False)
    rng = random.Random(2)
    old = _rows(rng, [None] * 300 + ["old only"] * 300 + ["both"] * 40 + ["b", "b", "o"])
    new = _rows(rng, [None] * 200 + ["new only"] * 300 + ["both"] * 30 + ["b", "n"])
    d1, d2 = make_tasks(spark, old), make_tasks(spark, new)
    want = brute_summary(old, new, mode == "match")
    join = c.migration_join(d1, d2, null_keys=mode)
    got = {r.side: r["count"] for r in join.groupBy("side").count().collect()}
    assert (got["left_only"], got["right_only"]) == (want["only_old"], want["only_new"])
    assert sum(got.values()) == sum(want.values())
    matched = join.filter("side = 'both'")
    assert matched.select("address", "zip_old", "zip_new").distinct().count() == got["both"]
    assert matched.filter("zip_old is null or zip_new is null").count() == 0
    assert _shuffled_rows(join) < 6 * (len(old) + len(new))
    for bucket in ("changed_lost", "lost_only"):
        lost = c.migration_bucket(d1, d2, bucket, null_keys=mode)
        assert lost.count() == want[bucket]
        assert _shuffled_rows(lost) < 6 * (len(old) + len(new))


def test_exact_copies_get_different_parts(spark):
    d = make_tasks(spark, [{"address": None, "zip": "1"}] * 600).select("zip", "city")
    shares = [r["count"] for r in d.select(c._own(d.columns, F.lit(8)).alias("p")).groupBy("p").count().collect()]
    assert len(shares) == 8 and max(shares) < 150


def test_the_task_table_leaves_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = found(), spark.conf.get(name, None)
    table = fx.tasks.__wrapped__(spark, SF001)
    for _ in range(40):
        if not found() - before:
            break
        time.sleep(0.25)
    assert not found() - before
    assert spark.conf.get(name, None) == was
    assert table.count() == spark.read.parquet(f"{SF001}/lineitem.parquet").count()
