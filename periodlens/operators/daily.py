"""Date x store report (R20; A8, A12, D1-D4, C6).

The core is a long table ``(platform, period, event_date, store_id)`` with
sales, payouts and distinct orders per cell.  Rows are tagged with every
window they fall in by a range join against the 4-row period dimension, so
overlapping windows work.  Totals are grouping sets over the cells (summing
cell values, as the export does; a distinct count across cells would give a
different number).  The wide date x store layout has one column per store that the
caller lists, one for all other stores and one for the day's total; ``pages``
has a column for every store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM, zero_if_null
from ..params import PERIODS, ReportParams
from .facts import exclude_days, tag_periods, window_filter

DAILY_VALUES = ("sales", "payouts", "orders")
# Columns of the wide layout beside the listed stores.
TOTAL, OTHER = "Total", "Other"


def daily_cells_dec(fact: DataFrame, params: ReportParams,
                    periods: Sequence[str] = PERIODS) -> DataFrame:
    """Per platform, period, day and store: sums and distinct orders.

    A fact that already has a ``period`` column (one file per window, S11)
    keeps it; otherwise rows are tagged by date (J7)."""
    if "period" in fact.columns:
        tagged = exclude_days(fact.where(F.col("period").isin(*periods)), params.excluded)
    else:
        rows = exclude_days(window_filter(fact, params, periods), params.excluded)
        tagged = tag_periods(rows, params, periods=periods)
    tagged = tagged.where("store_id IS NOT NULL")  # groups without a key are dropped (G22)
    payouts = F.col("payouts")
    if "payouts_hist" in fact.columns:
        # Last-year blocks of the date export take the historical payout column
        payouts = F.expr("CASE WHEN period IN ('pre_24', 'post_24') THEN payouts_hist ELSE payouts END")
    # one aggregate: Spark's single-distinct plan groups by (cell, order) with
    # the money partial sums riding along, then by cell.  Splitting money from
    # the distinct count was measured slower here (a second scan and range join
    # cost more than the two sums saved on the shuffle).
    return tagged.groupBy("platform", "period", "event_date", "store_id").agg(
        zero_if_null(F.sum("sales"), MONEY_SUM).alias("sales"),
        zero_if_null(F.sum(payouts), MONEY_SUM).alias("payouts"),
        F.count_distinct("order_id").alias("orders"))


def daily_store(fact: DataFrame, params: ReportParams, metric: str) -> DataFrame:
    """One metric in long form: platform, period, event_date, store_id, value."""
    cells = daily_cells_dec(fact, params)
    value = F.col(metric) if metric == "orders" else F.col(metric).cast("double")
    return cells.select("platform", "period", "event_date", "store_id", value.alias(metric))


def daily_cube(cells_dec: DataFrame) -> DataFrame:
    """Cells plus Total column (per day), Total row (per
    store) and the corner, per platform and period."""
    g = cells_dec.groupingSets(
        [["platform", "period", "event_date", "store_id"],
         ["platform", "period", "event_date"],
         ["platform", "period", "store_id"],
         ["platform", "period"]],
        "platform", "period", "event_date", "store_id")
    out = g.agg(*[F.sum(c).alias(c) for c in DAILY_VALUES],
                F.grouping("event_date").alias("is_total_row"),
                F.grouping("store_id").alias("is_total_col"))
    return out.select("platform", "period", "event_date", "store_id",
                      F.col("is_total_row").cast("int").alias("is_total_row"),
                      F.col("is_total_col").cast("int").alias("is_total_col"),
                      *[F.col(c).cast("double").alias(c) for c in ("sales", "payouts")],
                      "orders")


def daily_wide(cells_dec: DataFrame, store_ids: Sequence[str],
               metrics: Sequence[str] = DAILY_VALUES) -> DataFrame:
    """Per platform, period and metric one row per day plus a Total row
    (``event_date`` null); one column per listed store, ``Other`` for all other
    stores and ``Total``; missing cells are 0.  A listed store whose name is one of
    the report's own columns gets the column ``store <name>``.

    Sums are exact (DECIMAL) until the last cast.  One pass over the cells: the
    metrics become rows and grouping sets add the totals.  The plan depends on
    the listed stores only, not on how many the data has."""
    structs = ", ".join(f"named_struct('metric', '{m}', 'v', CAST(`{m}` AS {MONEY_SUM}))" for m in metrics)
    long = cells_dec.selectExpr("platform", "period", "event_date", "store_id", f"inline(array({structs}))")
    listed = list(dict.fromkeys(str(s) for s in store_ids))
    taken = {n.lower() for n in ("platform", "period", "metric", "event_date", OTHER, TOTAL)}
    names = {i: f"store {i}" if i.lower() in taken else i for i in listed}
    column = {i: "'" + i.replace("'", "\\'") + "'" for i in listed}
    other = f"store_id NOT IN ({', '.join(column.values())})" if listed else "TRUE"

    def total(condition: str, name: str):
        return F.expr(f"CAST(coalesce(sum(CASE WHEN {condition} THEN v END), 0) AS DOUBLE)").alias(name)

    keys = ["platform", "period", "metric"]
    wide = long.groupingSets([[*keys, "event_date"], keys], *keys, "event_date").agg(
        *[total(f"store_id = {sql}", names[i]) for i, sql in column.items()], total(other, OTHER), total("TRUE", TOTAL))
    return wide.select(*keys, "event_date", *[F.col(f"`{c}`") for c in (*names.values(), OTHER, TOTAL)])
