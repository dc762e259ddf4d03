"""Incremental landing of export drops into a Parquet fact table.

Uploaded exports arrive as files in a folder.  A Structured Streaming file
source picks up each new file once (its progress lives in the query's
checkpoint).  A micro-batch is a set of whole files, which the batch scans of
``sources.exports`` read: every file's own header is resolved, so files whose
columns differ in order land correctly, and the one-format-per-file date rule
applies.  The rows go to a Parquet table partitioned by platform (or channel)
and month; reports then read that table with partition pruning and pushed date
filters instead of re-parsing CSV.

Writes are idempotent: each batch overwrites only its own ``batch_id``
partition (dynamic partition overwrite), so a batch replayed after a
failure replaces its earlier output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.exports import campaign_fact, order_fact
from ..sources.specs import SourceSpec
from ..staging import Staging


# Columns of Spark's binary file source; all but the path are pruned.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _land(spark: SparkSession, source_dir: str, out_path: str, checkpoint: str,
          scan: Callable[[SparkSession, list[str], Staging], DataFrame], partition_cols: list[str],
          max_files_per_trigger: int, available_now: bool) -> StreamingQuery:
    # only the paths of new files are read from the stream, at most
    # ``max_files_per_trigger`` at a time
    stream = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .load(source_dir).select("path"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())
        if not paths:
            return
        staging = Staging(batch.sparkSession)
        (scan(batch.sparkSession, paths, staging)
         .withColumn("event_month", F.date_format("event_date", "yyyy-MM"))
         .withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partition_cols, "event_month", "batch_id").parquet(out_path))
        staging.drop()

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def land_orders(spark: SparkSession, source_dir: str, spec: SourceSpec, out_path: str, checkpoint: str,
                max_files_per_trigger: int = 100, available_now: bool = True) -> StreamingQuery:
    """Start the landing stream for one order-export family."""
    return _land(spark, source_dir, out_path, checkpoint, lambda s, paths, staging: order_fact(s, paths, spec, staging=staging),
                 ["platform"], max_files_per_trigger, available_now)


def land_campaigns(spark: SparkSession, source_dir: str, spec: SourceSpec, channel: str,
                   out_path: str, checkpoint: str, max_files_per_trigger: int = 100,
                   available_now: bool = True, undated: str = "error") -> StreamingQuery:
    """The same for promotion or sponsored-listing files (partitioned by
    channel and the month of the campaign date)."""
    return _land(spark, source_dir, out_path, checkpoint,
                 lambda s, paths, staging: campaign_fact(s, paths, spec, channel, undated, staging),
                 ["channel"], max_files_per_trigger, available_now)


def read_landed(spark: SparkSession, path: str, params=None) -> DataFrame:
    """The landed fact.  With report parameters, only the months that hold a
    report window are read (partition pruning on ``event_month``), and rows
    without a date (campaign files landed with ``undated="keep"``)."""
    df = spark.read.parquet(path)
    if params is not None:
        months = sorted({f"{d.year:04d}-{d.month:02d}"
                         for s, e in params.windows.values() for d in _month_starts(s, e)})
        df = df.where(F.col("event_month").isin(*months) | F.col("event_month").isNull())
    return df.drop("batch_id")


def _month_starts(start, end):
    import datetime as dt
    d = dt.date(start.year, start.month, 1)
    while d <= end:
        yield d
        d = dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)
