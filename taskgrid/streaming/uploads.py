"""Per-upload coverage profile for task lists landing in a folder.

Each file dropped in the folder is one upload. The stream reads new files,
and every micro-batch profiles its uploads with the batch operators and
writes the rows to ``<out>/batch=<id>``. A file is read whole within one
micro-batch, so no state is kept between batches; rewriting a batch's own
folder makes a retried batch idempotent. Progress lives in the checkpoint
folder, which must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taskgrid.config import DEFAULT, TASK_TYPES, TaskConfig
from taskgrid.operators import quality as q
from taskgrid.sources.files import normalise


def upload_stream(spark: SparkSession, folder: str, columns: Mapping[str, str] | None = None,
                  cfg: TaskConfig = DEFAULT, max_files: int = 100) -> DataFrame:
    """Streaming task rows with an ``upload`` column (the file's path).

    Stream sources need a declared schema: files must carry ``columns`` (by
    default the task columns) in that order; the header is checked against it.
    """
    cols = dict(columns or TASK_TYPES)
    ddl = ", ".join(f"`{c}` string" for c in cols)
    raw = (spark.readStream.option("header", True).option("enforceSchema", False)
                .option("maxFilesPerTrigger", max_files).schema(ddl).csv(folder))
    raw = raw.withColumn("upload", F.col("_metadata.file_path"))
    return normalise(raw, cfg, cols)


def profile_uploads(spark: SparkSession, folder: str, out: str, checkpoint: str,
                    columns: Mapping[str, str] | None = None, cfg: TaskConfig = DEFAULT,
                    once: bool = False) -> StreamingQuery:
    """Start the stream; ``once`` processes what is there and stops."""
    stream = upload_stream(spark, folder, columns, cfg)

    def write(batch: DataFrame, batch_id: int) -> None:
        (q.coverage_by(batch, ["upload"], cfg).withColumn("batch", F.lit(batch_id))
          .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
