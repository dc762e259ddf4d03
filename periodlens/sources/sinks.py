"""Report sinks and display formatting (K1-K4).

The report is written as one dataset per table (Parquet by default, or CSV /
JSON), each tagged with ``run_id`` and ``operator`` partition columns, so a
re-run with the same ``run_id`` overwrites only its own partition (dynamic
partition overwrite) and concurrent runs never clobber each other.  ``write_run``
writes all tables of a run or none: readers follow the manifest that commits it.  The
workbook layout of the source application is presentation; ``format_*``
gives the same text for a table when a display copy is wanted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels
from . import files as fs

PARTITIONS = ("run_id", "operator")


def write_table(df: DataFrame, path: str, run_id: str, operator: str = "",
                fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """K1: write one report table under ``path`` partitioned by run and operator."""
    out = df.withColumn("run_id", F.lit(run_id)).withColumn("operator", F.lit(operator or "default"))
    w = (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*PARTITIONS, *partition_by))
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_report(tables: Mapping[str, DataFrame], out_dir: str, run_id: str, operator: str = "",
                 fmt: str = "parquet") -> dict[str, str]:
    """K1: every table of a report, one dataset each, ``out_dir/<table>``."""
    return {name: write_table(df, f"{out_dir.rstrip('/')}/{name}", run_id, operator, fmt)
            for name, df in tables.items()}


def write_daily(cells: DataFrame, out_dir: str, run_id: str, operator: str = "",
                fmt: str = "parquet") -> str:
    """K2 / K3: the date export in long form, partitioned by platform, metric
    and period (one folder per block of the source workbook)."""
    return write_table(daily_long(cells), f"{out_dir.rstrip('/')}/daily", run_id, operator, fmt,
                       partition_by=("platform", "metric", "period"))


# ---------------------------------------------------------------- whole runs

MANIFESTS = "_manifests"


def daily_long(cells: DataFrame) -> DataFrame:
    """K2 / K3: the date export in long form."""
    return cells.select("platform", "period", "event_date", "store_id",
                        F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
                                           for c, name in (("sales", "Sales"), ("payouts", "Payouts"), ("orders", "Orders"))])))


def write_run(spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str, run_id: str, operator: str = "", fmt: str = "parquet",
              partitions: Mapping[str, tuple[str, ...]] | None = None) -> str:
    """K1-K3: all tables of a run, or none of them.

    Tables are written below a hidden folder of the run.  When the last one is
    there, their folders are renamed to ``out_dir/<table>/run_id=...`` and the run's
    manifest (schema, number of files and bytes of each table) is renamed into
    place, which commits it: ``read_run`` knows only runs that have a manifest.  If
    writing fails, nothing of the run is seen.  A run written again under its old id
    is not readable until it is whole again.  ``partitions`` names further partition
    columns of a table.  Returns the manifest's path."""
    out = out_dir.rstrip("/")
    hidden, manifest = f"{out}/_runs/{run_id}-{uuid.uuid4().hex[:8]}", f"{out}/{MANIFESTS}/{run_id}.json"
    entry = {"run_id": run_id, "operator": operator or "default", "format": fmt, "tables": {}}
    try:
        for name, df in tables.items():
            write_table(df, f"{hidden}/{name}", run_id, operator, fmt, (partitions or {}).get(name, ()))
            files, size = fs.usage(spark, f"{hidden}/{name}/run_id={run_id}")
            entry["tables"][name] = {"schema": json.loads(df.schema.json()), "files": files, "bytes": size}
        fs.write_text(spark, f"{hidden}/_manifest", json.dumps(entry))
        fs.remove(spark, manifest)
        for name in tables:
            target = f"{out}/{name}/run_id={run_id}"
            fs.remove(spark, target)
            if fs.exists(spark, f"{hidden}/{name}/run_id={run_id}"):  # a table without rows has no partition
                fs.rename(spark, f"{hidden}/{name}/run_id={run_id}", target)
        fs.rename(spark, f"{hidden}/_manifest", manifest)
    finally:
        fs.remove(spark, hidden)
    return manifest


def runs(spark: SparkSession, out_dir: str) -> list[str]:
    """Ids of the committed runs."""
    return [fs.basename(p).removesuffix(".json") for p in fs.glob(spark, f"{out_dir.rstrip('/')}/{MANIFESTS}/*.json")]


def read_run(spark: SparkSession, out_dir: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a committed run, each with its ``run_id`` and ``operator``.

    Raises ``LookupError`` if the run is not committed, ``ValueError`` if files of it are missing."""
    out = out_dir.rstrip("/")
    path = f"{out}/{MANIFESTS}/{run_id}.json"
    if not fs.exists(spark, path):
        raise LookupError(f"run {run_id} is not committed in {out}")
    entry = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    found = {}
    for name, t in entry["tables"].items():
        schema = T.StructType.fromJson(t["schema"]).add("run_id", "string").add("operator", "string")
        folder = f"{out}/{name}/run_id={run_id}"
        if fs.usage(spark, folder) != (t["files"], t["bytes"]):
            raise ValueError(f"table {name} of run {run_id} is not as it was committed")
        if t["files"] == 0:
            found[name] = spark.createDataFrame([], schema)
            continue
        reader = spark.read.schema(schema).option("basePath", f"{out}/{name}")
        found[name] = (reader.option("header", True) if entry["format"] == "csv" else reader).format(entry["format"]).load(folder)
    return found


# ---------------------------------------------------------------- K4 display text

def _by_metric(metric: Column, v: Column) -> Column:
    return (F.when(metric.isin("Orders", "New Customers"), labels.int_text(v))
            .when(metric == "Profitability", labels.pct_text(v))
            .otherwise(labels.money_text(v)))


def format_summary(df: DataFrame) -> DataFrame:
    """Summary table text: counts as integers, Profitability as %, money as
    ``$1,234.5``, growth columns as ``12.3%``."""
    out = []
    for c in df.columns:
        if c in ("growth_pct", "yoy_pct", "change_pct"):
            out.append(labels.pct_text(c).alias(c))
        elif c in ("pre", "post", "prevs_post", "last_year_pre_vs_post", "last_year_post", "yoy", "change"):
            out.append(_by_metric(F.col("metric"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def format_campaign(df: DataFrame) -> DataFrame:
    """Campaign table text: Orders integer, money with two decimals, ROAS ratio."""
    out = []
    for c in df.columns:
        if c == "orders":
            out.append(labels.int_text(c).alias(c))
        elif c in ("sales", "spend", "cost_per_order"):
            out.append(labels.money_text(c, 2).alias(c))
        elif c == "roas":
            out.append(labels.number_text(c, 2).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def format_store_table(df: DataFrame) -> DataFrame:
    """Store table text: money ``$1,234.5`` and percentages ``12.3%``."""
    out = []
    for c in df.columns:
        if c.endswith("_pct"):
            out.append(labels.pct_text(c).alias(c))
        elif c in ("pre", "post", "prevs_post", "last_year_pre_vs_post", "last_year_post", "yoy"):
            out.append(labels.money_text(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def display_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """K4: the display text of a report's tables, as ``<table>_text``."""
    out = {}
    for name, df in tables.items():
        if name.startswith(("platform_summary_pre", "platform_summary_yoy", "combined_summary_")):
            out[f"{name}_text"] = format_summary(df)
        elif name.startswith("campaign_"):
            out[f"{name}_text"] = format_campaign(df)
        elif name.startswith(("store_table_", "combined_store_")):
            out[f"{name}_text"] = format_store_table(df)
    return out
