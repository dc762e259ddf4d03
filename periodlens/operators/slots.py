"""Time-of-day slot tables (R3; A7, J8, M9, M13-M15).

Rows of the pre, post and last-year post windows are assigned a slot from
their minute of day and summed per (platform, slot) in one aggregate.  The
tables always have all six slots (a fixed 12-row grid joined on the left),
whether or not a window has data; unlike the source report, an empty Pre
window does not blank the Post figures (G5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM
from ..functions.slots import PLATFORM_BOUNDS, SLOT_NAMES, slot_by_platform_sql
from ..params import ReportParams, window_flags_sql
from .compare import pct_or_zero_sql
from .facts import report_rows

SLOT_PERIODS = ("pre_25", "post_25", "post_24")
# Platforms that have slot tables.
PLATFORMS = ("DD", "UE")


def slot_grid(spark: SparkSession, platforms=PLATFORMS) -> DataFrame:
    rows = [(p, s, i) for p in platforms for i, s in enumerate(SLOT_NAMES)]
    return spark.createDataFrame(rows, "platform string, slot string, slot_order int")


def slot_totals(fact: DataFrame, params: ReportParams, bounds_by_platform: dict | None = None,
                platforms=PLATFORMS) -> DataFrame:
    """Per (platform, slot): sales and payouts in pre, post and last-year post."""
    rows = report_rows(fact, params, SLOT_PERIODS)
    rows = rows.withColumn("slot", F.expr(slot_by_platform_sql(
        bounds_by_platform=bounds_by_platform or PLATFORM_BOUNDS)))
    flags = window_flags_sql(params, periods=SLOT_PERIODS)
    agg = rows.where("slot IS NOT NULL").groupBy("platform", "slot").agg(
        *[F.expr(f"sum(CASE WHEN {c} THEN {m} END) AS {m}__{p}")
          for p, c in flags.items() for m in ("sales", "payouts")])
    grid = slot_grid(fact.sparkSession, platforms)
    # the grid has a fixed 6 rows per platform; the aggregate at most as many
    out = grid.join(F.broadcast(agg), ["platform", "slot"], "left")
    return out.selectExpr("platform", "slot", "slot_order",
                          *[f"CAST(coalesce({m}__{p}, 0) AS {MONEY_SUM}) AS {m}__{p}"
                            for p in SLOT_PERIODS for m in ("sales", "payouts")])


def slot_pre_post(totals: DataFrame, measure: str = "sales") -> DataFrame:
    pre, post = f"{measure}__pre_25", f"{measure}__post_25"
    return totals.selectExpr(
        "platform", "slot", "slot_order",
        f"CAST({pre} AS DOUBLE) AS pre", f"CAST({post} AS DOUBLE) AS post",
        f"CAST({post} - {pre} AS DOUBLE) AS pre_vs_post",
        f"bround({pct_or_zero_sql(f'({post} - {pre})', pre)}, 1) AS growth_pct")


def slot_yoy(totals: DataFrame, measure: str = "sales") -> DataFrame:
    ly, post = f"{measure}__post_24", f"{measure}__post_25"
    return totals.selectExpr(
        "platform", "slot", "slot_order",
        f"CAST({ly} AS DOUBLE) AS last_year_post", f"CAST({post} AS DOUBLE) AS post",
        f"CAST({post} - {ly} AS DOUBLE) AS yoy",
        f"bround({pct_or_zero_sql(f'({post} - {ly})', ly)}, 1) AS growth_pct")
