import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from taskgrid.config import TASK_TYPES  # noqa: E402

SF001 = "/root/testdata/sf0.001"
TASK_COLUMNS = list(TASK_TYPES)
TASK_DDL = ", ".join(f"{c} {t}" for c, t in TASK_TYPES.items())


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="taskgrid-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("taskgrid-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


def make_tasks(spark, rows: list[dict]):
    """A task table with the full schema; missing fields are null."""
    data = [tuple(r.get(c) for c in TASK_COLUMNS) for r in rows]
    return spark.createDataFrame(data, TASK_DDL)


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="taskgrid-test-")
