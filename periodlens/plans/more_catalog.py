"""Registered queries: every store on pages, stored order sets, windows and ranges as data,
whole reports, and rows where the zero rules fire."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..operators import compare, daily, facts, insights, marketing, ordersets, pages, ranges, summary
from ..params import ReportParams
from ..sources import sinks
from ..sources import testviews as tv
from ..staging import Staging
from .catalog import PE, P, _cmp, _nc, _sel, query

#: Columns of a page in the registered queries.
PAGE_WIDTH = 16
# Requests where the zero rules and overlapping windows fire.
SPARSE = ReportParams.of(pre=(dt.date(1998, 1, 5), dt.date(1998, 1, 5)), post=(dt.date(1998, 7, 6), dt.date(1998, 7, 7)))
BEFORE = ReportParams.of(pre=(dt.date(1990, 1, 1), dt.date(1990, 6, 30)), post=(dt.date(1998, 1, 1), dt.date(1998, 6, 30)))
OVERLAP = ReportParams.of(pre=(dt.date(1998, 1, 1), dt.date(1998, 9, 30)), post=(dt.date(1998, 6, 1), dt.date(1999, 3, 31)), excluded=P.excluded)
MIDNIGHT = ReportParams.of(pre=(PE.pre_start, PE.pre_end), post=(PE.post_start, PE.post_end), end_at_midnight=True)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_cells_dec(tv.order_fact(spark, sf), P)


@query("daily_store_pages")
def daily_store_pages(spark, sf):
    """Every store has a column; rows per page, platform, window, metric and day."""
    staging = Staging(spark)
    cells = staging.put(_cells(spark, sf), "cells")
    return pages.store_pages(cells, pages.page_header(staging, cells, PAGE_WIDTH), PAGE_WIDTH)


@query("daily_store_page_header")
def daily_store_page_header(spark, sf):
    """Which store each page and place stands for."""
    return pages.page_header(Staging(spark), _cells(spark, sf), PAGE_WIDTH)


@query("orders_from_daily_sets")
def orders_from_daily_sets(spark, sf):
    """A3: distinct orders per store and window from stored daily bitmaps."""
    staging, fact = Staging(spark), tv.order_fact(spark, sf)
    sets = staging.put(ordersets.daily_sets(fact, ordersets.number_orders(staging, fact)), "sets")
    return ordersets.orders_in_windows(sets, P)


@query("window_batch_totals")
def window_batch_totals(spark, sf):
    """Totals per platform over one window per customer (many overlap)."""
    windows = tv.table(spark, sf, "customer").selectExpr(
        "c_custkey AS window_id", "date_add(DATE'1995-01-01', CAST(c_custkey * 37 % 2400 AS INT)) AS start_date",
        "date_add(DATE'1995-01-01', CAST(c_custkey * 37 % 2400 + c_custkey * 11 % 400 AS INT)) AS end_date")
    days = ranges.day_totals(tv.order_fact(spark, sf), ["platform"])
    return compare.as_double(ranges.window_totals_batch(days, windows), ranges.MEASURES)


@query("range_totals")
def range_totals(spark, sf):
    """One date range per order, answered from running sums per store, excluded days left out."""
    asked = tv.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS range_id", "IF(o_orderstatus = 'F', 'DD', 'UE') AS platform", "CAST(1 + o_custkey % 120 AS STRING) AS store_id",
        "CAST(o_orderdate AS DATE) AS start_date", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 200 - 4 AS INT)) AS end_date")
    days = ranges.day_totals(facts.exclude_days(tv.order_fact(spark, sf), P.excluded), ["platform", "store_id"])
    return compare.as_double(ranges.range_totals(days, asked), ranges.MEASURES)


@query("report_roundtrip")
def report_roundtrip(spark, sf):
    """K1-K3: tables of a run written whole, committed, and read back through the manifest."""
    staging = Staging(spark)
    cmp = staging.put(_cmp(spark, sf), "compare")
    tables = {"store_compare": compare.as_double(cmp, compare.COMPARE_COLS), "platform_growth": insights.platform_growth(cmp),
              "best_worst_stores": insights.best_worst_stores(compare.as_double(cmp.where("metric = 'sales'"), compare.COMPARE_COLS))}
    out = staging.path("report")
    sinks.write_run(spark, tables, out, "r1", P.operator)
    return sinks.read_run(spark, out, "r1")["store_compare"].drop("run_id", "operator")


# ------------------------------------------------------------------ rows where the branches fire

@query("store_compare_zero_base")
def store_compare_zero_base(spark, sf):
    """M2: windows of a day or two, so that many stores have no sales before and the base is 1."""
    return compare.store_compare(tv.order_fact(spark, sf), SPARSE, ["sales", "orders"])


@query("platform_summary_zero_base")
def platform_summary_zero_base(spark, sf):
    """M3, M5, M6: a pre window before all data, so that totals of zero stand below."""
    cmp = compare.store_compare_dec(tv.order_fact(spark, sf), BEFORE)
    nc = summary.new_customers_dec(tv.campaign_fact(spark, sf), BEFORE)
    return summary.table1(summary.platform_summary(cmp, _sel(spark, sf), nc))


@query("store_table_empty_rows")
def store_table_empty_rows(spark, sf):
    """of windows of a day or two, stores without sales in both are left out."""
    return compare.store_table_pre_post(compare.store_compare_dec(tv.order_fact(spark, sf), SPARSE, ["sales", "payouts", "orders"]), _sel(spark, sf))


@query("campaign_zero_ratios")
def campaign_zero_ratios(spark, sf):
    """M7: campaigns by discount and line, some without spend and some without orders."""
    fact = tv.campaign_fact_by_discount(spark, sf)
    return marketing.campaign_table(fact, P, "promotion")


@query("overlapping_windows")
def overlapping_windows(spark, sf):
    """Pre and post share four months; their rows count in both."""
    return compare.store_compare(tv.order_fact(spark, sf), OVERLAP, ["sales", "orders"])


@query("end_at_midnight")
def end_at_midnight(spark, sf):
    """windows that end at midnight of their last day, over events with a time."""
    return compare.store_compare(tv.slot_fact(spark, sf), MIDNIGHT, ["sales"])


# ------------------------------------------------------------------ K4

@query("display_summary")
def display_summary(spark, sf):
    """K4: display text of the platform summary."""
    return sinks.format_summary(summary.table1(summary.platform_summary(_cmp(spark, sf), _sel(spark, sf), _nc(spark, sf))))


@query("display_campaigns")
def display_campaigns(spark, sf):
    """K4: display text of the promotion table."""
    return sinks.format_campaign(marketing.campaign_table(tv.campaign_fact(spark, sf), P, "promotion"))


@query("display_store_table")
def display_store_table(spark, sf):
    """K4: display text of the store table."""
    return sinks.format_store_table(compare.store_table_pre_post(_cmp(spark, sf), _sel(spark, sf)))
