"""Distinct orders of any window from stored daily sets (A3).

Counts of distinct orders cannot be added, sets can.  Per platform and store
the orders are numbered densely in the order of their first day, and per store
and day the numbers are kept as bitmaps (buckets of 32,768).  The distinct
orders of any window are the bits of the union of its days' bitmaps: exact, and
without reading an order row again.  New drops only add: unseen orders get the
store's next numbers, and sets of the same day are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import PERIODS, ReportParams
from ..staging import Staging, numbered
from .facts import report_rows, tag_periods

STORE = ["platform", "store_id"]


def number_orders(staging: Staging, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``platform, store_id, order_id, number`` (from 1, dense per store) of all orders;
    ``known`` is an earlier result, whose numbers stay."""
    seen = rows.where("store_id IS NOT NULL AND order_id IS NOT NULL").groupBy(*STORE, "order_id").agg(F.min("event_date").alias("_first"))
    if known is None:
        ranked = numbered(staging, seen, ["_first", "order_id"], STORE)
        return staging.put(ranked.select(*STORE, "order_id", (F.col("rank") + 1).alias("number")), "order_numbers")
    fresh = numbered(staging, seen.join(known, [*STORE, "order_id"], "left_anti"), ["_first", "order_id"], STORE)
    last = known.groupBy(*STORE).agg(F.max("number").alias("_last"))
    fresh = fresh.join(last, STORE, "left").select(*STORE, "order_id", (F.col("rank") + 1 + F.coalesce("_last", F.lit(0))).alias("number"))
    return staging.put(known.unionByName(fresh), "order_numbers")


def daily_sets(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``platform, store_id, event_date, bucket, orders`` (bitmap): the state that is stored."""
    # one row per order and day first, so that a hot store's rows are combined where they are; the numbers
    # grow with the orders and are stored small, so they are not to be broadcast for their file size
    days = rows.select(*STORE, "order_id", "event_date").distinct().join(numbers.hint("merge"), [*STORE, "order_id"])
    # numbers are shuffled, not bitmaps of 4 KB: most stores have few orders a day, and none more than a bucket's
    bits = days.select(*STORE, "event_date", F.expr("bitmap_bucket_number(number)").alias("bucket"), F.expr("bitmap_bit_position(number)").alias("_bit"))
    return bits.repartition(*STORE, "event_date", "bucket").groupBy(*STORE, "event_date", "bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("orders"))


def united(*sets: DataFrame) -> DataFrame:
    """Sets of several drops as one."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy(*STORE, "event_date", "bucket").agg(F.expr("bitmap_or_agg(orders)").alias("orders"))


def orders_in_windows(sets: DataFrame, params: ReportParams, periods=PERIODS) -> DataFrame:
    """Distinct orders per platform, store and window (a column each) from stored sets."""
    tagged = tag_periods(report_rows(sets, params, periods), params, periods=periods)
    unions = tagged.groupBy(*STORE, "period", "bucket").agg(F.expr("bitmap_count(bitmap_or_agg(orders))").alias("n"))
    return unions.groupBy(*STORE).agg(*[F.expr(f"coalesce(sum(CASE WHEN period = '{p}' THEN n END), 0)").alias(p) for p in periods])
