"""Insights, movers and rankings (R12-R19; T1-T4, M12).

Insights use all stores (G14).  Rankings are ``row_number`` windows with a
small ``k``; Spark inserts a per-partition group limit before the shuffle,
so each platform's ranking moves at most ``k`` rows per map task.  Sorted
"movers" lists are ordered by absolute change with the name as an explicit
tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import MONEY_SUM, pct_or_zero, zero_if_null
from ..params import ReportParams
from .compare import as_double, pct_or_zero_sql
from .facts import report_rows, select_stores, selection_rows

MOVER_COLS = ("pre", "post", "change", "change_pct")


def _movers(df: DataFrame, keys, pre: str, post: str) -> DataFrame:
    """Change, Change % and Direction between two numeric columns."""
    p, q = f"CAST(`{pre}` AS DOUBLE)", f"CAST(`{post}` AS DOUBLE)"
    chg = f"({q} - {p})"
    return df.selectExpr(
        *[f"`{k}`" for k in keys],
        f"bround({p}, 1) AS pre", f"bround({q}, 1) AS post", f"bround({chg}, 1) AS change",
        f"bround({pct_or_zero_sql(chg, p)}, 1) AS change_pct",
        f"CASE WHEN {chg} > 0 THEN '{labels.GAIN}' WHEN {chg} < 0 THEN '{labels.LOSS}' "
        f"ELSE '{labels.NO_CHANGE}' END AS direction")


def order_by_change(df: DataFrame, name_col: str) -> DataFrame:
    return df.orderBy(F.abs(F.col("change")).desc(), F.col(name_col).asc())


def summary_movers(combined: DataFrame) -> DataFrame:
    """Combined summary metrics (table 1) by absolute change."""
    return order_by_change(_movers(combined, ["metric"], "pre", "post"), "metric")


def platform_summary_movers(platform_summary: DataFrame) -> DataFrame:
    """R13 per platform: its summary metrics (table 1) by absolute change."""
    moved = _movers(platform_summary, ["platform", "metric"], "pre", "post")
    return moved.orderBy("platform", F.abs(F.col("change")).desc(), "metric")


def store_movers(sources: list[tuple[str, DataFrame]], k: int = 20) -> DataFrame:
    """Top ``k`` stores by absolute sales change, taken from the first
    non-empty source in priority order (Combined, DoorDash, UberEats)."""
    parts = [_movers(t, ["store_id"], "pre", "post")
             .withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(i))
             for i, (name, t) in enumerate(sources)]
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    first = allrows.agg(F.min("source_rank").alias("source_rank"))
    chosen = allrows.join(F.broadcast(first), "source_rank", "left_semi")
    top = order_by_change(chosen, "store_id").limit(k)
    return top.select("source", "store_id", *MOVER_COLS, "direction")


def slot_movers(slot_pre_post_dd: DataFrame) -> DataFrame:
    """Slots of a pre/post slot table by absolute change."""
    return order_by_change(_movers(slot_pre_post_dd, ["slot"], "pre", "post"), "slot")


def platform_totals(compare_dec: DataFrame) -> DataFrame:
    """Per platform, sum of (rounded) store sales in pre and post, all stores."""
    s = compare_dec.where(F.col("metric") == "sales")
    return s.groupBy("platform").agg(
        zero_if_null(F.sum("pre_25"), "decimal(38,4)").alias("pre"),
        zero_if_null(F.sum("post_25"), "decimal(38,4)").alias("post"))


def platform_movers(compare_dec: DataFrame) -> DataFrame:
    """Pre and post sales per platform with change and direction."""
    return order_by_change(_movers(platform_totals(compare_dec), ["platform"], "pre", "post"),
                           "platform")


def platform_growth(compare_dec: DataFrame) -> DataFrame:
    """Total sales growth % per platform (zero when pre is zero)."""
    t = platform_totals(compare_dec)
    return t.select("platform", F.bround(pct_or_zero(F.col("post") - F.col("pre"), "pre"), 1)
                    .alias("growth_pct"))


def top_bottom(df: DataFrame, part: str, value: str, name: str, k: int) -> DataFrame:
    """Bottom ``k`` and top ``k`` rows by ``value`` within each ``part``."""
    w_lo = Window.partitionBy(part).orderBy(F.col(value).asc(), F.col(name).asc())
    w_hi = Window.partitionBy(part).orderBy(F.col(value).desc(), F.col(name).asc())
    lo = (df.withColumn("rank", F.row_number().over(w_lo)).where(F.col("rank") <= k)
          .withColumn("kind", F.lit("worst")))
    hi = (df.withColumn("rank", F.row_number().over(w_hi)).where(F.col("rank") <= k)
          .withColumn("kind", F.lit("best")))
    return lo.unionByName(hi)


def best_worst_stores(compare: DataFrame, k: int = 3) -> DataFrame:
    """Three lowest and three highest store Growth% per platform."""
    s = compare.where((F.col("metric") == "sales") & F.col("growth_pct").isNotNull())
    s = s.select("platform", "store_id", F.col("growth_pct").cast("double").alias("growth_pct"))
    return top_bottom(s, "platform", "growth_pct", "store_id", k).select(
        "platform", "kind", "rank", "store_id", "growth_pct")


def daily_sales(fact: DataFrame, params: ReportParams, period: str = "post_25") -> DataFrame:
    """Sales per platform and day inside one window (excluded days removed)."""
    rows = report_rows(fact, params, periods=(period,))
    return rows.groupBy("platform", "event_date").agg(
        zero_if_null(F.sum("sales"), MONEY_SUM).cast("double").alias("sales"))


def best_worst_dates(fact: DataFrame, params: ReportParams, k: int = 5) -> DataFrame:
    """Five weakest and five strongest post-window days per platform."""
    d = daily_sales(fact, params)
    return top_bottom(d, "platform", "sales", "event_date", k).select(
        "platform", "kind", "rank", "event_date", "sales")


def store_directory(compare_dec: DataFrame, stores=None) -> DataFrame:
    """Distinct ids of the selection (all stores with data if nothing
    is selected), DD stores first then UE-only ones, each group sorted, with an
    empty Markups column."""
    s = selection_rows(compare_dec.where(F.col("metric") == "sales"), stores)
    d = s.groupBy("store_id").agg(
        F.min(F.when(F.col("platform") == "DD", F.lit(0)).otherwise(F.lit(1))).alias("source_rank"))
    return (d.select("store_id", F.when(F.col("source_rank") == 0, F.lit("DD"))
                     .otherwise(F.lit("UE")).alias("first_platform"),
                     F.lit("").alias("markups"), "source_rank")
            .orderBy("source_rank", "store_id"))


__all__ = ["summary_movers", "platform_summary_movers", "store_movers", "slot_movers", "platform_movers",
           "platform_growth", "best_worst_stores", "best_worst_dates", "store_directory",
           "daily_sales", "as_double", "select_stores"]
