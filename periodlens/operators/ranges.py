"""Totals over windows that are data (J7, P2) and over date ranges per store.

``window_totals_batch`` answers any number of overlapping windows at once: the
calendar is cut into buckets of days, a window is the buckets that it covers
whole plus the days of the (at most two) buckets that it covers in part, and
both kinds of pieces are equi-joined by bucket.  No window is compared with a
day outside its buckets.

``range_totals`` answers ranges per store by running sums: the total of a range
is the running total as of its last day less that as of the day before its
first; both are as-of lookups over the store's days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM

BUCKET_DAYS = 32
#: Copies of the day totals, so that windows of one bucket are spread over tasks.
SALT = 8
MEASURES = ("sales", "payouts")


def day_totals(fact: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Per key and day: number of rows and exact sums (rows without a key or date are dropped)."""
    for k in (*keys, "event_date"):
        fact = fact.where(F.col(k).isNotNull())
    return fact.groupBy(*keys, "event_date").agg(
        F.count(F.lit(1)).alias("rows"), *[F.expr(f"CAST(coalesce(sum({m}), 0) AS {MONEY_SUM})").alias(m) for m in measures])


def window_totals_batch(days: DataFrame, windows: DataFrame, keys: Sequence[str] = ("platform",),
                        measures: Sequence[str] = MEASURES, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """Per window and key (that has rows in it): rows and sums.

    ``days`` is a result of ``day_totals``; ``windows`` has ``window_id``,
    ``start_date`` and ``end_date``, both days inclusive; windows that end before
    they start, or have a null, hold nothing."""
    b, values = bucket_days, ["rows", *measures]
    numbered = days.withColumn("_day", F.expr("unix_date(event_date)")).withColumn("_bucket", F.expr(f"floor(_day / {b})"))
    whole = numbered.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
    pieces = windows.selectExpr("window_id", "unix_date(start_date) AS _from", "unix_date(end_date) AS _to").where("_from <= _to")
    pieces = pieces.selectExpr("*", f"explode(sequence(floor(_from / {b}), floor(_to / {b}))) AS _bucket",
                               f"pmod(xxhash64(window_id), {SALT}) AS _salt")
    covered = f"_from <= _bucket * {b} AND _to >= _bucket * {b} + {b - 1}"
    salts = ", ".join(f"{i}L" for i in range(SALT))

    def salted(df: DataFrame) -> DataFrame:
        return df.selectExpr("*", f"explode(array({salts})) AS _salt")

    full = pieces.where(covered).join(salted(whole), ["_bucket", "_salt"])
    part = pieces.where(f"NOT ({covered})").join(salted(numbered), ["_bucket", "_salt"]).where("_day BETWEEN _from AND _to")
    both = full.select("window_id", *keys, *values).unionByName(part.select("window_id", *keys, *values))
    return both.groupBy("window_id", *keys).agg(*[F.sum(v).alias(v) for v in values])


def running_totals(days: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Running rows and sums per key, one row per day that has rows (a window holds a
    key's days, never its rows)."""
    w = Window.partitionBy(*keys).orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*keys, "event_date", *[F.sum(v).over(w).alias(v) for v in ("rows", *measures)])


def range_totals(days: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("platform", "store_id"),
                 measures: Sequence[str] = MEASURES) -> DataFrame:
    """Per range (``range_id``, ``keys``, ``start_date``, ``end_date``, both inclusive): rows and
    sums of its key's days in it.  Zero where there are none, or where the range is empty.

    Lookups are made once per key and day, however many ranges ask for them."""
    keys, values = list(keys), ["rows", *measures]
    ends = ranges.selectExpr(
        "range_id", *keys, "start_date", "end_date",
        "inline(CASE WHEN start_date <= end_date THEN array(named_struct('_asof', end_date, '_sign', 1), "
        "named_struct('_asof', date_sub(start_date, 1), '_sign', -1)) ELSE array(named_struct('_asof', CAST(NULL AS DATE), '_sign', 0)) END)")
    asked = ends.where("_asof IS NOT NULL").select(*keys, F.col("_asof").alias("event_date")).distinct()
    totals = running_totals(days, keys, measures)
    marked = totals.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("event_date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    found = marked.select(*keys, F.col("event_date").alias("_asof"), "_asked", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    found = found.where("_asked = 1").drop("_asked")
    joined = ends.join(found, [*keys, "_asof"], "left")
    return joined.groupBy("range_id", *keys, "start_date", "end_date").agg(*[F.expr(f"coalesce(sum(_sign * {v}), 0)").alias(v) for v in values])
