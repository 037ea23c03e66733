"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session (once)."""
    sc = spark.sparkContext
    if getattr(sc, "_taskgrid_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "taskgrid_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._taskgrid_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(text: Column, ddl: str, make: Callable[[], Callable], every: bool = False) -> Column:
    """A struct column computed from each whole text.

    ``make`` runs once per Arrow batch inside the task and returns the function
    that maps one text (UTF-8 bytes, null read as empty) to the tuple of the
    struct's fields, or with ``every`` an iterable of texts to their tuples.
    Only the text column travels to Python; all other columns of a row stay in
    the JVM."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(ddl)

    def run(texts: pa.Array) -> pa.Array:
        fn = make()
        data = (t.as_py() or b"" for t in texts)
        rows = list(fn(data) if every else map(fn, data))
        cols = list(zip(*rows)) if rows else [()] * len(schema.fields)
        fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, fields)],
                                          fields=fields)
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)(text.cast("binary"))
