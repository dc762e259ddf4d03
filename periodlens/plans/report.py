"""One request -> every report table.

Every table is produced for every request, whichever front end asks (G19),
and a platform without rows still yields its (empty) tables (G20).  Nothing
is cached across runs (G18): each run materialises its own inputs.

``run_report`` builds all tables of a report from the canonical facts.  Before
it returns it writes what several tables share as Parquet in a staging folder
that all executors see: order rows cut to the windows, campaign rows, the store
comparison, the day x store cells, the slot totals and the combined summary.
Each raw export is scanned once, every table reads the staged data, and a lost
executor only re-reads it.  ``drop_staging`` removes the folder when the tables
have been written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM
from ..functions import labels
from ..operators import compare, daily, facts, insights, marketing, slots, summary
from ..params import PERIODS, ReportParams, period_dim
from ..session import checkpoint_dir


@dataclass
class ReportInputs:
    """Canonical facts for one report.

    ``orders``: order fact of both platforms (with ``minute_of_day`` for slots).
    ``campaigns``: campaign fact (promotion and sponsored rows), optional.
    ``dd_new_customers``: per-period DD new customers ``(period, store_id,
    new_customers)`` from legacy files; used only when ``campaigns`` has no
    new-customer data.
    ``ue_new_customers``: UE platform totals, either ``(period,
    new_customers)`` or a dated fact ``(event_date, new_customers)``.
    ``rejects``: rejected rows by file and reason (``sources.exports.rejects``).
    """
    orders: DataFrame
    campaigns: DataFrame | None = None
    dd_new_customers: DataFrame | None = None
    ue_new_customers: DataFrame | None = None
    rejects: DataFrame | None = None


def staging_path(spark: SparkSession, run_id: str, staging: str | None = None) -> str:
    """Folder of a run's shared inputs: under ``staging``, else under the cluster's
    ``spark.checkpoint.dir``."""
    return f"{(staging or checkpoint_dir(spark)).rstrip('/')}/periodlens/{run_id}"


def materialize(spark: SparkSession, df: DataFrame, name: str, run_id: str, staging: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the run's staging folder and read it back
    (cuts lineage; survives executor loss)."""
    path = f"{staging_path(spark, run_id, staging)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staging(spark: SparkSession, run_id: str, staging: str | None = None) -> None:
    """Remove the run's staging folder; its lazy tables cannot be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_path(spark, run_id, staging))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _periods_to_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, period, new_customers)`` -> one row per key with the four
    windows and their changes."""
    aggs = [F.coalesce(F.sum(F.when(F.col("period") == p, F.col("new_customers"))), F.lit(0))
            .cast(MONEY_SUM).alias(p) for p in PERIODS]
    t = df.groupBy(*keys).agg(*aggs)
    return t.select(*keys, *PERIODS,
                    (F.col("post_25") - F.col("pre_25")).alias("prevs_post"),
                    (F.col("post_24") - F.col("pre_24")).alias("last_year_pre_vs_post"),
                    (F.col("post_25") - F.col("post_24")).alias("yoy"))


def run_report(spark: SparkSession, params: ReportParams, inputs: ReportInputs, stores=None,
               run_id: str | None = None, reuse: bool = True, staging: str | None = None) -> dict[str, DataFrame]:
    """Every table of the report as lazy DataFrames (write them with
    ``sources.sinks.write_report``).  The shared inputs are written first, see
    above; ``reuse=False`` writes nothing and every table computes its own.
    ``stores`` is any selection of ``facts.select_stores`` (default: that of
    ``params``)."""
    run_id = run_id or uuid.uuid4().hex[:12]
    stores = params.stores if stores is None else stores

    def shared(df: DataFrame, name: str) -> DataFrame:
        return materialize(spark, df, name, run_id, staging) if reuse else df

    fact = shared(facts.report_rows(inputs.orders, params), "order_fact")
    cmp_dec = shared(compare.store_compare_dec(fact, params), "store_compare")
    cells = shared(daily.daily_cells_dec(fact, params), "daily_cells")
    campaigns = None if inputs.campaigns is None else shared(inputs.campaigns, "campaign_fact")

    # new customers: DD per store, UE platform totals.  The legacy per-period
    # files stand in when there is no campaign folder or it gave none at all.
    nc_dec = None
    if campaigns is not None:
        nc_dec = shared(summary.new_customers_dec(campaigns, params), "new_customers")
    if inputs.dd_new_customers is not None and (nc_dec is None or nc_dec.isEmpty()):
        nc_dec = _periods_to_row(inputs.dd_new_customers, ["store_id"])
    ue_nc_dec = None
    if inputs.ue_new_customers is not None:
        u = inputs.ue_new_customers
        ue_nc_dec = (_periods_to_row(u, []) if "period" in u.columns
                     else summary.ue_new_customer_totals_dec(u, params))

    t: dict[str, DataFrame] = {}
    t["store_compare"] = compare.as_double(cmp_dec, compare.COMPARE_COLS)
    t1 = compare.store_table_pre_post_dec(cmp_dec, stores)
    t2 = compare.store_table_yoy_dec(cmp_dec, stores)
    t["store_table_pre_post"] = compare.as_double(t1, compare.TABLE1_COLS)
    t["store_table_yoy"] = compare.as_double(t2, compare.TABLE2_COLS)
    t["combined_store_pre_post"] = compare.combined_store_pre_post(t1)
    t["combined_store_yoy"] = compare.combined_store_yoy(t2)

    plat = summary.platform_summary(cmp_dec, stores, nc_dec)
    comb = shared(summary.combined_summary(cmp_dec, stores, nc_dec, ue_nc_dec), "combined_summary")
    t["platform_summary_pre_post"] = summary.table1(plat)
    t["platform_summary_yoy"] = summary.table2(plat)
    t["combined_summary_pre_post"] = summary.table1(comb)
    t["combined_summary_yoy"] = summary.table2(comb)
    if nc_dec is not None:
        t["new_customers_by_store"] = compare.as_double(nc_dec, summary.SUM_COLS)
    if ue_nc_dec is not None:
        t["ue_new_customer_totals"] = compare.as_double(ue_nc_dec, summary.SUM_COLS)

    if campaigns is not None:
        t["campaign_promotion"] = marketing.campaign_table(campaigns, params, "promotion")
        t["campaign_sponsored"] = marketing.campaign_table(campaigns, params, "sponsored")
        t["campaign_combined"] = marketing.campaign_combined(campaigns, params)

    if "minute_of_day" in fact.columns:
        st = shared(slots.slot_totals(fact, params), "slot_totals")
        for m in ("sales", "payouts"):
            t[f"slot_{m}_pre_post"] = slots.slot_pre_post(st, m)
            t[f"slot_{m}_yoy"] = slots.slot_yoy(st, m)
        t["slot_movers"] = insights.slot_movers(
            t["slot_sales_pre_post"].where(F.col("platform") == "DD"))

    t["daily_cells"] = cells.select("platform", "period", "event_date", "store_id",
                                    F.col("sales").cast("double").alias("sales"),
                                    F.col("payouts").cast("double").alias("payouts"), "orders")
    t["daily_cube"] = daily.daily_cube(cells)

    counts = summary.store_counts(cmp_dec, stores)
    kpi = summary.kpis(comb, summary.selected_counts(cmp_dec, stores))
    t["kpis"] = kpi.drop("ue_selected_stores")
    t["summary_metrics"] = summary.summary_metrics(kpi, params)
    t["store_coverage"] = counts
    t["store_directory"] = insights.store_directory(cmp_dec, stores).drop("source_rank")
    t["summary_movers"] = insights.summary_movers(summary.table1(comb))
    t["platform_summary_movers"] = insights.platform_summary_movers(summary.table1(plat))
    t["store_movers"] = insights.store_movers(
        list(zip(labels.MOVER_SOURCES,
                  [t["combined_store_pre_post"],
                   t1.where(F.col("platform") == "DD").drop("platform"),
                   t1.where(F.col("platform") == "UE").drop("platform")])), 20)
    t["platform_movers"] = insights.platform_movers(cmp_dec)
    t["platform_growth"] = insights.platform_growth(cmp_dec)
    t["best_worst_stores"] = insights.best_worst_stores(t["store_compare"])
    post_days = cells.where(F.col("period") == "post_25").groupBy("platform", "event_date").agg(
        F.sum("sales").cast("double").alias("sales"))
    t["best_worst_dates"] = insights.top_bottom(post_days, "platform", "sales", "event_date", 5).select(
        "platform", "kind", "rank", "event_date", "sales")
    lo, hi = params.suggested_download
    t["report_windows"] = period_dim(spark, params).select(
        "*", (F.datediff("end_date", "start_date") + 1).alias("days"), F.lit(lo).alias("download_from"), F.lit(hi).alias("download_to"))
    if inputs.rejects is not None:
        t["rejected_rows"] = inputs.rejects
    t["summary_line"] = summary_line(summary.table1(comb), params.operator)
    return t


def summary_line(combined_t1: DataFrame, operator: str = "") -> DataFrame:
    """The one-line message sent with a finished report."""
    s = combined_t1.where(F.col("metric") == "Sales")
    return s.select(F.concat(
        F.lit(f"Report ready for operator: {operator or 'default'} | Sales Pre: "),
        F.col("pre").cast("string"), F.lit(" | Sales Post: "), F.col("post").cast("string"),
        F.lit(" | Growth: "), F.col("growth_pct").cast("string"), F.lit("%")).alias("summary"))
