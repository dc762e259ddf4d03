"""Registered queries over export text: the supplied tables are written as CSV
exports (``sources.textexports``) and read back by the real scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily, marketing, slots
from ..params import ReportParams
from ..sources import exports
from ..sources import textexports as tx
from ..staging import Staging
from .catalog import P, query

#: The first file of a folder holds its first half-year: a request whose post window lies there.
FIRST_HALF = ReportParams.of(pre=(dt.date(1997, 7, 1), dt.date(1997, 12, 31)), post=(dt.date(1998, 1, 1), dt.date(1998, 6, 30)), excluded=P.excluded)
MONEY_COLS = ("sales", "payouts", "payouts_hist")


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _dd_rows(spark: SparkSession, sf: str, staging: Staging) -> DataFrame:
    return exports.order_rows(spark, tx.dd_files(spark, sf, staging), exports.DD_ORDERS, staging)


def _ue_rows(spark: SparkSession, sf: str, staging: Staging) -> DataFrame:
    return exports.order_rows(spark, tx.ue_files(spark, sf, staging), exports.UE_ORDERS, staging)


def _clean(rows: DataFrame) -> DataFrame:
    out = _doubles(exports.facts_of(rows), *MONEY_COLS)
    return out.select(tx.file_name().alias("file"), "store_id", "order_id", "event_date", "minute_of_day", *MONEY_COLS)


@query("clean_orders_dd")
def clean_orders_dd(spark, sf):
    """DD exports in two column orders, one date format a file."""
    return _clean(_dd_rows(spark, sf, Staging(spark)))


@query("clean_orders_ue")
def clean_orders_ue(spark, sf):
    """UE exports below a banner, dates by row, columns by place."""
    return _clean(_ue_rows(spark, sf, Staging(spark)))


@query("clean_campaigns")
def clean_campaigns(spark, sf):
    """Promotion and sponsored files of all folders."""
    staging = Staging(spark)
    base = tx.campaign_root(spark, sf, staging)
    root = exports.marketing_root(spark, base)
    rows = [exports.marketing_rows(spark, root, kind, staging=staging) for kind in exports.KINDS]
    out = _doubles(rows[0].unionByName(rows[1]), "orders", "sales", "spend", "new_customers")
    return out.select("channel", tx.file_name().alias("file"), "store_id", "campaign_key", "event_date", "nc_date",
                      "orders", "sales", "spend", "new_customers")


@query("campaign_first_file")
def campaign_first_file(spark, sf):
    """The promotion table of the first file of each folder."""
    staging = Staging(spark)
    fact = exports.promotions(spark, tx.campaign_root(spark, sf, staging), first_per_folder=True, staging=staging)
    return marketing.campaign_table(fact, FIRST_HALF, "promotion")


@query("slots_from_text_times")
def slots_from_text_times(spark, sf):
    """Year-over-year slot sales of both platforms from clock text."""
    staging = Staging(spark)
    fact = exports.facts_of(_dd_rows(spark, sf, staging).unionByName(_ue_rows(spark, sf, staging)))
    return slots.slot_yoy(slots.slot_totals(fact, P), "sales")


@query("rejects_by_reason")
def rejects_by_reason(spark, sf):
    """What order and campaign files lost, by file and reason."""
    staging = Staging(spark)
    root = tx.campaign_root(spark, sf, staging)
    parts = [_dd_rows(spark, sf, staging), _ue_rows(spark, sf, staging), *[exports.marketing_rows(spark, root, k, staging=staging) for k in exports.KINDS]]
    out = None
    for p in map(exports.rejects, parts):
        out = p if out is None else out.unionByName(p)
    return out.select(F.regexp_extract(exports.FILE_COL, r"((?:marketing_[^/]*/)?[^/]*)$", 1).alias("file"), F.col("reject_reason").alias("reason"), "rows")


@query("file_profile")
def file_profile(spark, sf):
    """S10 per file: rows, parsed dates, the first ten columns, of DD and UE exports."""
    staging = Staging(spark)
    found = [exports.profile(spark, paths, spec, staging) for paths, spec in (
        (tx.dd_files(spark, sf, staging), exports.DD_ORDERS), (tx.ue_files(spark, sf, staging), exports.UE_ORDERS))]
    return found[0].unionByName(found[1]).select(tx.file_name().alias("file"), "rows", "start_date", "end_date", "columns", "date_column_found")


@query("legacy_new_customers")
def legacy_new_customers(spark, sf):
    """New customers from one file per window (DD by store without excluded days, UE totals)."""
    staging = Staging(spark)
    dd, ue = tx.legacy_files(spark, sf, staging, P)
    stores = exports.legacy_dd_new_customers(spark, dd, P.excluded, staging).groupBy("period", "store_id").agg(F.sum("new_customers").alias("new_customers"))
    totals = exports.legacy_ue_new_customer_totals(spark, ue, staging).withColumn("store_id", F.lit(None).cast("string"))
    both = stores.withColumn("platform", F.lit("DD")).unionByName(totals.withColumn("platform", F.lit("UE")))
    return _doubles(both, "new_customers").select("platform", "period", "store_id", "new_customers")


@query("period_files_daily")
def period_files_daily(spark, sf):
    """Cells of the date export from one DD file per window; last-year windows take the historical payouts."""
    staging = Staging(spark)
    fact = exports.orders_by_period_files(spark, tx.period_files(spark, sf, staging, P), exports.DD_ORDERS, staging)
    return _doubles(daily.daily_cells_dec(fact, P), "sales", "payouts").select("platform", "period", "event_date", "store_id", "sales", "payouts", "orders")


@query("upload_groups")
def upload_groups(spark, sf):
    """Campaign totals of uploaded promotion files by the group that their names give."""
    staging = Staging(spark)
    rows = exports.facts_of(exports.uploaded_rows(spark, tx.uploaded(spark, sf, staging), "PROMOTION", staging=staging))
    grouped = rows.groupBy("upload_group").agg(F.count_distinct(exports.FILE_COL).alias("files"), F.count(F.lit(1)).alias("rows"),
                                               *[F.sum(c).cast("double").alias(c) for c in ("orders", "sales", "spend")])
    return grouped.select("upload_group", "files", "rows", "orders", "sales", "spend")
