"""Campaign efficiency by campaign type (R9; A6, J4, M7, M11, F6).

Campaign tables cover the post window only.  Rows with no campaign key are
dropped (G22).  Sums are exact DECIMAL totals; ROAS and Cost per Order are
unrounded ratios that are zero when their denominator is zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import MONEY_SUM
from ..params import ReportParams
from .facts import report_rows

CAMPAIGN_VALUES = ("orders", "sales", "spend")
CAMPAIGN_COLS = ("orders", "sales", "spend", "roas", "cost_per_order")


def _post_rows(campaign_fact: DataFrame, params: ReportParams) -> DataFrame:
    """Post-window rows with a campaign key; rows of undated files (kept only
    with ``undated="keep"``) pass whatever the window (F6)."""
    if "undated" in campaign_fact.columns:
        dated = report_rows(campaign_fact.where(~F.col("undated")), params, periods=("post_25",))
        rows = dated.unionByName(campaign_fact.where(F.col("undated")))
    else:
        rows = report_rows(campaign_fact, params, periods=("post_25",))
    return rows.where(F.col("campaign_key").isNotNull())


def _finish(df: DataFrame, keys) -> DataFrame:
    k = "lower(trim(CAST(campaign_key AS STRING)))"
    label = (f"CASE WHEN {k} IN ('false', '0') THEN '{labels.CORPORATE}' "
             f"WHEN {k} IN ('true', '1') THEN '{labels.TODC}' ELSE CAST(campaign_key AS STRING) END")
    return df.selectExpr(
        *keys, f"{label} AS campaign_label",
        *[f"CAST({c} AS DOUBLE) AS {c}" for c in CAMPAIGN_VALUES],
        "CASE WHEN spend = 0 THEN 0.0D ELSE CAST(sales AS DOUBLE) / CAST(spend AS DOUBLE) END AS roas",
        "CASE WHEN orders = 0 THEN 0.0D ELSE CAST(spend AS DOUBLE) / CAST(orders AS DOUBLE) END"
        " AS cost_per_order")


def campaign_table(campaign_fact: DataFrame, params: ReportParams, channel: str) -> DataFrame:
    """Promotion or sponsored-listing table: one row per campaign key."""
    rows = _post_rows(campaign_fact, params).where(F.col("channel") == channel)
    agg = rows.groupBy("campaign_key").agg(
        *[F.expr(f"CAST(coalesce(sum({c}), 0) AS {MONEY_SUM}) AS {c}") for c in CAMPAIGN_VALUES])
    return _finish(agg.withColumn("channel", F.lit(channel)), ["channel", "campaign_key"])


def campaign_combined(campaign_fact: DataFrame, params: ReportParams,
                      channels=("promotion", "sponsored")) -> DataFrame:
    """Both channels summed by campaign key, ratios recomputed (J4; the key
    union U2 is the group-by itself).  Rows come ordered by key (G16)."""
    rows = _post_rows(campaign_fact, params).where(F.col("channel").isin(*channels))
    agg = rows.groupBy("campaign_key").agg(
        *[F.expr(f"CAST(coalesce(sum({c}), 0) AS {MONEY_SUM}) AS {c}") for c in CAMPAIGN_VALUES])
    return _finish(agg, ["campaign_key"]).orderBy("campaign_key")
