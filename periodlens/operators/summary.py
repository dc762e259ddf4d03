"""Summary tables over selected stores (R4, R5, R7, R8, R10, R11, R22; A4, A5,
A9, A10, M3, M5, M6).

The summaries add up store values that were already rounded to one decimal
(G2); Profitability and Average Check are ratios of those rounded totals.
Every total is one grouped aggregate over at most one row per store, so the
work here is small next to the store comparison it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numeric import MONEY_SUM
from ..params import PERIODS, ReportParams
from .compare import DELTAS, METRIC_NAMES, as_double, metric_rows, pct_or_zero_sql, window_totals
from .facts import select_stores, selection_rows, window_filter

SUM_COLS = PERIODS + DELTAS
BASE_METRICS = ("sales", "payouts", "orders", "new_customers")
# Row order of the summary tables.
SUMMARY_ORDER = ("sales", "payouts", "orders", "new_customers", "profitability", "average_check")
SUMMARY_COLS = ("pre", "post", "prevs_post", "last_year_pre_vs_post", "growth_pct",
                "last_year_post", "yoy", "yoy_pct")
T1 = ("pre", "post", "prevs_post", "last_year_pre_vs_post", "growth_pct")
T2 = ("last_year_post", "post", "yoy", "yoy_pct")


# ------------------------------------------------------------ new customers

def _delta_cols() -> list[Column]:
    return [(F.col("post_25") - F.col("pre_25")).alias("prevs_post"),
            (F.col("post_24") - F.col("pre_24")).alias("last_year_pre_vs_post"),
            (F.col("post_25") - F.col("post_24")).alias("yoy")]


def new_customers_dec(campaign_fact: DataFrame, params: ReportParams,
                      channel: str = "promotion") -> DataFrame:
    """Per store new customers in the four windows plus changes (no %).

    The four windows come from one conditional aggregation (J2), so a missing
    window is 0 and never disturbs the others (G8).

    Uses ``nc_date`` (one date format per file) when the fact has it."""
    date_col = "nc_date" if "nc_date" in campaign_fact.columns else "event_date"
    rows = campaign_fact.where((F.col("channel") == channel) & F.col("new_customers").isNotNull()
                               & F.col("store_id").isNotNull())
    t = window_totals(rows, params, keys=["store_id"], measures=["new_customers"],
                      count_orders=False, date_col=date_col)
    return t.select("store_id", *[F.col(f"new_customers__{p}").alias(p) for p in PERIODS],
                    *_delta_cols())


def new_customers_by_store(campaign_fact: DataFrame, params: ReportParams,
                           channel: str = "promotion") -> DataFrame:
    return as_double(new_customers_dec(campaign_fact, params, channel), SUM_COLS)


def ue_new_customer_totals_dec(ue_nc_fact: DataFrame, params: ReportParams) -> DataFrame:
    """Platform-level new customers per window (legacy files, no day exclusion)."""
    rows = window_filter(ue_nc_fact.where(F.col("new_customers").isNotNull()), params)
    t = window_totals(rows, params, keys=[], measures=["new_customers"], count_orders=False,
                      rows_filtered=True)
    return t.select(*[F.col(f"new_customers__{p}").alias(p) for p in PERIODS], *_delta_cols())


def ue_new_customer_totals(ue_nc_fact: DataFrame, params: ReportParams) -> DataFrame:
    return as_double(ue_new_customer_totals_dec(ue_nc_fact, params), SUM_COLS)


# ------------------------------------------------------------ summary tables

def _long_inputs(compare_dec: DataFrame, stores, nc_dec: DataFrame | None,
                 ue_nc_dec: DataFrame | None) -> DataFrame:
    """Union of the rows that feed the summaries, all on one schema."""
    vals = [f"CAST(`{c}` AS {MONEY_SUM}) AS `{c}`" for c in SUM_COLS]
    parts = [select_stores(compare_dec, stores).selectExpr("platform", "metric", *vals)]
    if nc_dec is not None:  # DD new customers: every store, not only selected ones (G7)
        parts.append(nc_dec.selectExpr("'DD' AS platform", "'new_customers' AS metric", *vals))
    if ue_nc_dec is not None:
        parts.append(ue_nc_dec.selectExpr("'UE' AS platform", "'new_customers' AS metric", *vals))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _metric_totals(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with ``<metric>_<col>`` sums for the base metrics."""
    aggs = [F.expr(f"CAST(coalesce(sum(CASE WHEN metric = '{m}' THEN `{c}` END), 0) AS decimal(38,4))"
                   f" AS `{m}_{c}`") for m in BASE_METRICS for c in SUM_COLS]
    return long.groupBy(*keys).agg(*aggs)


RATIOS = {"profitability": ("payouts", "sales", 100.0), "average_check": ("sales", "orders", 1.0)}


def _with_ratios(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add Profitability and Average Check per window, computed from the
    rounded totals (M5, M6), as plain columns so the row expressions built
    on them stay small."""
    base = [f"`{m}_{c}`" for m in BASE_METRICS for c in SUM_COLS]
    rounded = [f"CAST(bround(`{m}_{p}`, 1) AS DOUBLE) AS `r_{m}_{p}`"
               for m in ("sales", "payouts", "orders") for p in PERIODS]
    t = totals.selectExpr(*keys, *base, *rounded)
    ratios = []
    for name, (num, den, scale) in RATIOS.items():
        for p in PERIODS:
            v = f"CASE WHEN `r_{den}_{p}` = 0 THEN 0.0D ELSE `r_{num}_{p}` / `r_{den}_{p}` END"
            ratios.append(f"({v}) * {scale}D AS `{name}_{p}`" if scale != 1 else f"{v} AS `{name}_{p}`")
    return t.selectExpr(*keys, *base, *ratios)


def _metric_struct(m: str) -> str:
    def c(x):
        return f"`{m}_{x}`"
    vals = {
        "pre": f"bround({c('pre_25')}, 1)", "post": f"bround({c('post_25')}, 1)",
        "prevs_post": f"bround({c('prevs_post')}, 1)",
        "last_year_pre_vs_post": f"bround({c('last_year_pre_vs_post')}, 1)",
        "growth_pct": f"bround({pct_or_zero_sql(c('prevs_post'), c('pre_25'))}, 1)",
        "last_year_post": f"bround({c('post_24')}, 1)", "yoy": f"bround({c('yoy')}, 1)",
        "yoy_pct": f"bround({pct_or_zero_sql(c('yoy'), c('post_24'))}, 1)",
    }
    fields = ", ".join(f"'{k}', CAST({vals[k]} AS DOUBLE)" for k in SUMMARY_COLS)
    return (f"named_struct('metric', '{METRIC_NAMES[m]}', 'metric_order', {SUMMARY_ORDER.index(m)}, "
            f"{fields})")


def _ratio_struct(name: str) -> str:
    """Ratio rows: changes are differences of the unrounded ratios."""
    pre, post = f"`{name}_pre_25`", f"`{name}_post_25`"
    ly_pre, ly_post = f"`{name}_pre_24`", f"`{name}_post_24`"
    vals = {
        "pre": pre, "post": post, "prevs_post": f"({post} - {pre})",
        "last_year_pre_vs_post": f"({ly_post} - {ly_pre})",
        "growth_pct": f"CASE WHEN {pre} = 0 THEN 0.0D ELSE ({post} - {pre}) / {pre} * 100.0D END",
        "last_year_post": ly_post, "yoy": f"({post} - {ly_post})",
        "yoy_pct": f"CASE WHEN {ly_post} = 0 THEN 0.0D ELSE ({post} - {ly_post}) / {ly_post} * 100.0D END",
    }
    fields = ", ".join(f"'{k}', bround({vals[k]}, 1)" for k in SUMMARY_COLS)
    return (f"named_struct('metric', '{METRIC_NAMES[name]}', 'metric_order', "
            f"{SUMMARY_ORDER.index(name)}, {fields})")


def _summary_rows(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    structs = [_metric_struct(m) for m in BASE_METRICS] + [_ratio_struct(n) for n in RATIOS]
    return _with_ratios(totals, keys).select(*keys, F.expr(f"inline(array({', '.join(structs)}))"))


def platform_summary(compare_dec: DataFrame, stores=None, nc_dec: DataFrame | None = None,
                     nc_platforms: Sequence[str] = ("DD",)) -> DataFrame:
    """Per platform, the six summary rows with all columns of both tables.

    The New Customers row is shown only for platforms with per-store
    new-customer data (DD)."""
    long = _long_inputs(compare_dec, stores, nc_dec, None)
    rows = _summary_rows(_metric_totals(long, ["platform"]), ["platform"])
    return rows.where((F.col("metric") != METRIC_NAMES["new_customers"])
                      | F.col("platform").isin(*nc_platforms))


def combined_summary(compare_dec: DataFrame, stores=None, nc_dec: DataFrame | None = None,
                     ue_nc_dec: DataFrame | None = None) -> DataFrame:
    """The same six rows over both platforms; new customers are DD's
    per-store totals plus UE's platform totals."""
    long = _long_inputs(compare_dec, stores, nc_dec, ue_nc_dec)
    return _summary_rows(_metric_totals(long, []), [])


def table1(summary: DataFrame) -> DataFrame:
    keys = [c for c in summary.columns if c not in SUMMARY_COLS]
    return summary.select(*keys, *T1)


def table2(summary: DataFrame) -> DataFrame:
    keys = [c for c in summary.columns if c not in SUMMARY_COLS]
    return summary.select(*keys, *T2)


# ------------------------------------------------------------ KPIs

def kpis(combined: DataFrame, counts: DataFrame) -> DataFrame:
    """Headline growth numbers and payout lift per selected DD store.

    ``counts`` has (platform, selected_stores), from ``selected_counts`` or
    ``store_counts``.  The combined summary rows and the counts are stacked and
    folded by one global aggregate (no join)."""
    long = combined.select("metric", "growth_pct", "yoy_pct", "prevs_post").unionByName(
        counts.select("platform", "selected_stores"), allowMissingColumns=True)

    def pick(metric, col):
        return F.coalesce(F.max(F.when(F.col("metric") == METRIC_NAMES[metric], F.col(col))),
                          F.lit(0.0))

    def stores(platform):
        return F.coalesce(F.max(F.when(F.col("platform") == platform, F.col("selected_stores"))), F.lit(0))

    n = stores("DD")
    return long.agg(
        pick("sales", "growth_pct").alias("sales_growth_pct"),
        pick("sales", "yoy_pct").alias("sales_yoy_pct"),
        pick("orders", "growth_pct").alias("order_growth_pct"),
        pick("new_customers", "growth_pct").alias("new_customer_growth_pct"),
        n.alias("dd_selected_stores"),
        (pick("payouts", "prevs_post") / F.greatest(F.lit(1), n).cast("double"))
        .alias("payout_lift_per_store"),
        stores("UE").alias("ue_selected_stores"))


def selected_counts(compare_dec: DataFrame, stores=None) -> DataFrame:
    """Stores of the selection per platform, whether or not they have rows.  A
    selection is counted by itself; the comparison is read only where nothing
    is selected."""
    base = compare_dec.where(F.col("metric") == "sales").select("platform", "store_id")
    return selection_rows(base, stores).groupBy("platform").agg(F.count("*").alias("selected_stores"))


def store_counts(compare_dec: DataFrame, stores=None) -> DataFrame:
    """Stores selected and stores with data per platform, in one aggregate."""
    base = compare_dec.where(F.col("metric") == "sales").select("platform", "store_id")
    if stores is None:
        return base.groupBy("platform").agg(F.count("*").alias("selected_stores"), F.count("*").alias("total_stores"))
    marked = base.select("platform", F.lit(0).alias("s"), F.lit(1).alias("t")).unionByName(
        selection_rows(base, stores).select("platform", F.lit(1).alias("s"), F.lit(0).alias("t")))
    return marked.groupBy("platform").agg(F.sum("s").alias("selected_stores"), F.sum("t").alias("total_stores"))


def summary_metrics(kpi: DataFrame, params: ReportParams) -> DataFrame:
    """The ten-row Metric / Value table (text values) of one ``kpis`` row."""
    k = kpi.withColumnsRenamed({"dd_selected_stores": "dd", "ue_selected_stores": "ue"})

    def rng(a, b):
        return f"{a.month:02d}/{a.day:02d}/{a.year} - {b.month:02d}/{b.day:02d}/{b.year}"

    dd_name, ue_name = labels.PLATFORM_NAMES["DD"], labels.PLATFORM_NAMES["UE"]
    values = [
        F.concat(F.lit(f"{dd_name}: "), F.col("dd").cast("string"),
                 F.lit(f"  |  {ue_name}: "), F.col("ue").cast("string")),
        F.lit(rng(params.pre_start, params.pre_end)),
        F.lit(rng(params.post_start, params.post_end)),
        labels.pct_text("sales_growth_pct"),
        labels.pct_text("sales_yoy_pct"),
        labels.pct_text("order_growth_pct"),
        labels.pct_text("new_customer_growth_pct"),
        labels.money_text("payout_lift_per_store"),
        F.lit(""),
        F.lit(""),
    ]
    rows = list(zip(labels.SUMMARY_METRIC_ROWS, values))
    structs = [F.struct(F.lit(i).alias("row_order"), F.lit(name).alias("metric"), v.alias("value"))
               for i, (name, v) in enumerate(rows)]
    return k.select(F.inline(F.array(*structs)))


__all__ = ["new_customers_by_store", "ue_new_customer_totals", "platform_summary",
           "combined_summary", "table1", "table2", "kpis", "selected_counts", "store_counts", "summary_metrics",
           "metric_rows"]
