"""Intermediate tables in a folder that all executors see.

A staged table cuts lineage, survives the loss of executors and is read column
by column.  The folder is the caller's, else one below ``spark.checkpoint.dir``;
``drop`` removes it when nothing lazy reads it any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .session import checkpoint_dir


class Staging:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/periodlens/staged-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def path(self, name: str) -> str:
        """A new path in the folder."""
        self.n += 1
        return f"{self.folder}/{name}-{self.n}-{uuid.uuid4().hex[:6]}"

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(staging: Staging, rows: DataFrame, order: list[str], within: list[str] | tuple = (), out: str = "rank") -> DataFrame:
    """``rows`` with their number 0, 1, ... by ``order`` within each group of ``within``
    (or overall), whatever the size of a group.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus what earlier partitions hold of its group.  That offset table
    has a row per partition and group, so no window sees the rows themselves."""
    keys = [F.col(c).asc_nulls_first() for c in (*within, *order)]
    placed = staging.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    groups = [*within, "_part"]
    runs = placed.groupBy(*groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # without groups the window holds one row per partition of the data
    w = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select(*[F.col(c).alias(f"_g_{c}") for c in groups], (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift"))
    on = F.lit(True)
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = placed.join(shift, on)
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(out))
