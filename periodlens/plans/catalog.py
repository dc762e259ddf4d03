"""Registered report queries over the supplied Parquet tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built by
the library's operators from the mapped facts (see ``sources.testviews``).
Every query reads whole tables; column names equal those of the matching
SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slots import STANDARD
from ..functions import labels
from ..operators import compare, daily, facts, insights, marketing, slots, summary
from ..params import PERIODS, period_dim
from ..sources import exports
from ..sources import testviews as tv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

P = tv.LINEITEM_PARAMS
PE = tv.EVENTS_PARAMS


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _cmp(spark, sf, metrics=compare.METRICS):
    return compare.store_compare_dec(tv.order_fact(spark, sf), P, metrics)


def _sel(spark, sf):
    return tv.selected_stores(spark, sf)


def _nc(spark, sf):
    return summary.new_customers_dec(tv.campaign_fact(spark, sf), P)


def _ue_nc(spark, sf):
    return summary.ue_new_customer_totals_dec(tv.ue_new_customer_fact(spark, sf), P)


def _combined(spark, sf):
    return summary.combined_summary(_cmp(spark, sf), _sel(spark, sf), _nc(spark, sf), _ue_nc(spark, sf))


def excluded_days_frame(spark: SparkSession) -> DataFrame:
    """Excluded days as data: the three fixed days plus every Sunday of the
    report windows (a calendar generated by Spark, not a driver list)."""
    lo, hi = P.span()
    cal = spark.range((hi - lo).days + 1).select(
        F.date_add(F.lit(lo), F.col("id").cast("int")).alias("day"))
    fixed = spark.createDataFrame([(d,) for d in P.excluded], "day date")
    return cal.where(F.dayofweek("day") == 1).unionByName(fixed).distinct()


# ------------------------------------------------------------------ R1

@query("store_compare_sales")
def store_compare_sales(spark, sf):
    return compare.store_compare(tv.order_fact(spark, sf), P, ["sales"])


@query("store_compare_payouts")
def store_compare_payouts(spark, sf):
    return compare.store_compare(tv.order_fact(spark, sf), P, ["payouts"])


@query("store_compare_orders")
def store_compare_orders(spark, sf):
    return compare.store_compare(tv.order_fact(spark, sf), P, ["orders"])


@query("store_compare_excluded")
def store_compare_excluded(spark, sf):
    """R1 for all metrics with excluded days given as a DataFrame."""
    fact = facts.exclude_days(tv.order_fact(spark, sf), excluded_days_frame(spark), within=P.span())
    no_list = type(P)(P.pre_start, P.pre_end, P.post_start, P.post_end, (), None, P.operator)
    return compare.store_compare(fact, no_list)


# ------------------------------------------------------------------ R2, R6

@query("store_table_pre_post")
def store_table_pre_post(spark, sf):
    return compare.store_table_pre_post(_cmp(spark, sf), _sel(spark, sf))


@query("store_table_yoy")
def store_table_yoy(spark, sf):
    return compare.store_table_yoy(_cmp(spark, sf), _sel(spark, sf))


@query("combined_store_pre_post")
def combined_store_pre_post(spark, sf):
    return compare.combined_store_pre_post(
        compare.store_table_pre_post_dec(_cmp(spark, sf, ["sales"]), _sel(spark, sf)))


@query("combined_store_yoy")
def combined_store_yoy(spark, sf):
    return compare.combined_store_yoy(
        compare.store_table_yoy_dec(_cmp(spark, sf, ["sales"]), _sel(spark, sf)))


# ------------------------------------------------------------------ R4, R5

@query("platform_summary_pre_post")
def platform_summary_pre_post(spark, sf):
    return summary.table1(summary.platform_summary(_cmp(spark, sf), _sel(spark, sf), _nc(spark, sf)))


@query("platform_summary_yoy")
def platform_summary_yoy(spark, sf):
    return summary.table2(summary.platform_summary(_cmp(spark, sf), _sel(spark, sf), _nc(spark, sf)))


@query("combined_summary_pre_post")
def combined_summary_pre_post(spark, sf):
    return summary.table1(_combined(spark, sf))


@query("combined_summary_yoy")
def combined_summary_yoy(spark, sf):
    return summary.table2(_combined(spark, sf))


# ------------------------------------------------------------------ R7, R8, R9

@query("new_customers_by_store")
def new_customers_by_store(spark, sf):
    return summary.new_customers_by_store(tv.campaign_fact(spark, sf), P)


@query("new_customers_totals")
def new_customers_totals(spark, sf):
    return summary.ue_new_customer_totals(tv.ue_new_customer_fact(spark, sf), P)


@query("campaign_promotion")
def campaign_promotion(spark, sf):
    return marketing.campaign_table(tv.campaign_fact(spark, sf), P, "promotion")


@query("campaign_sponsored")
def campaign_sponsored(spark, sf):
    return marketing.campaign_table(tv.campaign_fact(spark, sf), P, "sponsored")


@query("campaign_combined")
def campaign_combined(spark, sf):
    return marketing.campaign_combined(tv.campaign_fact(spark, sf), P)


# ------------------------------------------------------------------ R3

def _slots(spark, sf, bounds=None):
    return slots.slot_totals(tv.slot_fact(spark, sf), PE, bounds)


@query("slot_sales_pre_post")
def slot_sales_pre_post(spark, sf):
    return slots.slot_pre_post(_slots(spark, sf), "sales")


@query("slot_sales_yoy")
def slot_sales_yoy(spark, sf):
    return slots.slot_yoy(_slots(spark, sf), "sales")


@query("slot_payouts_pre_post")
def slot_payouts_pre_post(spark, sf):
    return slots.slot_pre_post(_slots(spark, sf), "payouts")


@query("slot_payouts_yoy")
def slot_payouts_yoy(spark, sf):
    return slots.slot_yoy(_slots(spark, sf), "payouts")


@query("slot_standard_bounds")
def slot_standard_bounds(spark, sf):
    return slots.slot_pre_post(_slots(spark, sf, {"DD": STANDARD, "UE": STANDARD}), "sales")


# ------------------------------------------------------------------ R20

@query("daily_store_sales")
def daily_store_sales(spark, sf):
    return daily.daily_store(tv.order_fact(spark, sf), P, "sales")


@query("daily_store_payouts")
def daily_store_payouts(spark, sf):
    return daily.daily_store(tv.order_fact(spark, sf), P, "payouts")


@query("daily_store_orders")
def daily_store_orders(spark, sf):
    return daily.daily_store(tv.order_fact(spark, sf), P, "orders")


@query("daily_store_cube")
def daily_store_cube(spark, sf):
    return daily.daily_cube(daily.daily_cells_dec(tv.order_fact(spark, sf), P))


@query("daily_store_wide")
def daily_store_wide(spark, sf):
    """All blocks of the date report (platform x window x metric): ten listed
    stores, all others together, totals by day and by window."""
    return daily.daily_wide(daily.daily_cells_dec(tv.order_fact(spark, sf), P), tv.WIDE_STORES)


# ------------------------------------------------------------------ R10-R19, R22

def _kpi(spark, sf):
    return summary.kpis(_combined(spark, sf), summary.selected_counts(_cmp(spark, sf, ["sales"]), _sel(spark, sf)))


@query("kpis")
def kpis(spark, sf):
    return _kpi(spark, sf).drop("ue_selected_stores")


@query("summary_metrics")
def summary_metrics(spark, sf):
    return summary.summary_metrics(_kpi(spark, sf), P)


@query("store_coverage")
def store_coverage(spark, sf):
    return summary.store_counts(_cmp(spark, sf, ["sales"]), _sel(spark, sf))


@query("store_directory")
def store_directory(spark, sf):
    return insights.store_directory(_cmp(spark, sf, ["sales"]), _sel(spark, sf)).drop("source_rank")


@query("summary_movers")
def summary_movers(spark, sf):
    return insights.summary_movers(summary.table1(_combined(spark, sf)))


@query("summary_movers_platform")
def summary_movers_platform(spark, sf):
    """R13 per platform, with one store selection per platform."""
    plat = summary.platform_summary(_cmp(spark, sf), tv.selected_by_platform(spark, sf), _nc(spark, sf))
    return insights.platform_summary_movers(summary.table1(plat))


@query("store_movers_top20")
def store_movers_top20(spark, sf):
    c = _cmp(spark, sf, ["sales"])
    sel = _sel(spark, sf)
    t1 = compare.store_table_pre_post_dec(c, sel)
    comb = compare.combined_store_pre_post(t1)
    dd = t1.where(F.col("platform") == "DD").drop("platform")
    ue = t1.where(F.col("platform") == "UE").drop("platform")
    return insights.store_movers(list(zip(labels.MOVER_SOURCES, [comb, dd, ue])), 20)


@query("slot_movers")
def slot_movers(spark, sf):
    t = slots.slot_pre_post(_slots(spark, sf), "sales").where(F.col("platform") == "DD")
    return insights.slot_movers(t)


@query("platform_movers")
def platform_movers(spark, sf):
    return insights.platform_movers(_cmp(spark, sf, ["sales"]))


@query("platform_growth")
def platform_growth(spark, sf):
    return insights.platform_growth(_cmp(spark, sf, ["sales"]))


@query("best_worst_stores")
def best_worst_stores(spark, sf):
    return insights.best_worst_stores(compare.store_compare(tv.order_fact(spark, sf), P, ["sales"]))


@query("best_worst_dates")
def best_worst_dates(spark, sf):
    return insights.best_worst_dates(tv.order_fact(spark, sf), P)


# ------------------------------------------------------------------ P2, P3, J5-J7, S10

@query("period_dim")
def period_dim_q(spark, sf):
    """Period dimension with its coverage in the data."""
    pdim = period_dim(spark, P)
    rows = facts.report_rows(tv.order_fact(spark, sf), P)
    tagged = facts.tag_periods(rows, P)
    cov = tagged.groupBy("period").agg(F.count(F.lit(1)).alias("rows"),
                                       F.min("event_date").alias("first_date"),
                                       F.max("event_date").alias("last_date"))
    return (pdim.join(cov, "period", "left")
            .select("period", "period_order", "start_date", "end_date",
                    (F.datediff("end_date", "start_date") + 1).alias("days"),
                    F.coalesce("rows", F.lit(0)).alias("rows"), "first_date", "last_date",
                    F.lit(P.suggested_download[0]).alias("download_from"),
                    F.lit(P.suggested_download[1]).alias("download_to")))


@query("period_tag_range_join")
def period_tag_range_join(spark, sf):
    rows = facts.report_rows(tv.order_fact(spark, sf), P)
    tagged = facts.tag_periods(rows, P)
    return tagged.groupBy("platform", "period").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("sales").cast("double").alias("sales"))


@query("excluded_anti_join")
def excluded_anti_join(spark, sf):
    """Rows and sales per platform and window left after removing the
    excluded days with a broadcast anti join (J5)."""
    rows = facts.window_filter(tv.order_fact(spark, sf), P)
    kept = facts.exclude_days(rows, excluded_days_frame(spark), within=P.span())
    tagged = facts.tag_periods(kept, P)
    return tagged.groupBy("platform", "period").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("sales").cast("double").alias("sales"))


@query("selected_semi_join")
def selected_semi_join(spark, sf):
    c = compare.store_compare(tv.order_fact(spark, sf), P, ["sales"])
    return facts.select_stores(c, _sel(spark, sf)).select("platform", "store_id", "pre_25", "post_25")


@query("dataset_profile")
def dataset_profile(spark, sf):
    """Rows, date range, first column names and store count per platform of the order source."""
    names = tv.table(spark, sf, "lineitem").columns
    f = tv.order_fact(spark, sf)
    profile = exports.profile_rows(f, ["platform"], names, F.col("event_date"))
    stores = f.groupBy("platform").agg(F.count_distinct("store_id").alias("stores"))
    return profile.join(stores, "platform")


__all__ = ["QUERIES", "PERIODS", "excluded_days_frame"]
