"""End-to-end report (R21) and sinks (K1-K4)."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from periodlens import ReportParams
from periodlens.plans import verify
from periodlens.plans.report import ReportInputs, run_report
from periodlens.sources import exports, sinks
from periodlens.sources import testviews as tv
from tests import csvfix as fx
from tests.test_exports import _marketing_tree

SF = "/root/testdata/sf0.001"


def _same(a, b):
    return verify.canonical(a.columns, [tuple(r) for r in a.collect()]) == \
        verify.canonical(b.columns, [tuple(r) for r in b.collect()])


@pytest.fixture(scope="module")
def report(spark):
    inputs = ReportInputs(orders=tv.order_fact(spark, SF), campaigns=tv.campaign_fact(spark, SF),
                          ue_new_customers=tv.ue_new_customer_fact(spark, SF))
    return run_report(spark, tv.LINEITEM_PARAMS, inputs, stores=tv.selected_stores(spark, SF))


@pytest.mark.parametrize("table,query", [
    ("store_table_pre_post", "store_table_pre_post"),
    ("combined_store_yoy", "combined_store_yoy"),
    ("platform_summary_pre_post", "platform_summary_pre_post"),
    ("combined_summary_yoy", "combined_summary_yoy"),
    ("kpis", "kpis"),
    ("summary_metrics", "summary_metrics"),
    ("store_movers", "store_movers_top20"),
    ("best_worst_dates", "best_worst_dates"),
    ("campaign_combined", "campaign_combined"),
])
def test_report_tables_equal_registered_queries(spark, report, table, query):
    assert _same(report[table], ent.queries()[query](spark, SF))


def test_report_from_csv_and_sinks(spark, tmpdir_fresh):
    d = tmpdir_fresh
    dd = fx.dd_file(d, [["11/2/2025", "1:30 PM", "101", "a", "10", "8", "8"],
                        ["12/2/2025", "7:00 PM", "101", "b", "30", "20", "20"],
                        ["12/2/2024", "7:00 PM", "101", "c", "5", "4", "4"]])
    ue = fx.ue_file(d, [fx.ue_row("101", "u1", "12/3/2025", "11:15 AM", "4", "3")])
    mk = _marketing_tree(d)
    camp = exports.promotions(spark, mk).unionByName(exports.sponsored(spark, mk))
    p = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"), operator="alpha")
    t = run_report(spark, p, ReportInputs(orders=exports.orders(spark, [dd], [ue]), campaigns=camp),
                   run_id="t1")
    comb = {r.metric: r for r in t["combined_summary_pre_post"].collect()}
    assert (comb["Sales"].pre, comb["Sales"].post) == (10.0, 34.0)
    slot = {(r.platform, r.slot): r for r in t["slot_sales_pre_post"].collect()}
    assert slot[("DD", "Dinner")].post == 30.0 and slot[("UE", "Lunch")].post == 4.0
    assert t["summary_line"].collect()[0].summary.startswith("Report ready for operator: alpha")
    out = os.path.join(d, "out")
    paths = sinks.write_report({k: t[k] for k in ("kpis", "combined_summary_pre_post")}, out, "t1", "alpha")
    back = spark.read.parquet(paths["kpis"])
    assert back.where(F.col("run_id") == "t1").count() == 1
    sinks.write_daily(daily_cells_dec(spark, t), out, "t1", "alpha")
    assert spark.read.parquet(os.path.join(out, "daily")).select("metric").distinct().count() == 3
    txt = {r.metric: r for r in sinks.format_summary(t["combined_summary_pre_post"]).collect()}
    assert txt["Sales"].post == "$34.0" and txt["Orders"].post == "2"
    camp_txt = sinks.format_campaign(t["campaign_combined"]).collect()
    assert all(r.sales.startswith("$") for r in camp_txt)


def daily_cells_dec(spark, t):
    return t["daily_cells"]


def test_command_line_report(spark, tmpdir_fresh):
    from periodlens.__main__ import main
    d = tmpdir_fresh
    fx.dd_file(d, [["11/2/2025", "1:30 PM", "101", "a", "10", "8", "8"],
                   ["12/2/2025", "7:00 PM", "101", "b", "30", "20", "20"]])
    fx.ue_file(d, [fx.ue_row("102", "u1", "12/3/2025", "11:15 AM", "4", "3")])
    _marketing_tree(d)
    out = os.path.join(d, "out")
    assert main(["--dd", os.path.join(d, "dd-*.csv"), "--ue", os.path.join(d, "ue-*.csv"),
                 "--marketing", os.path.join(d, "marketing_data"), "--pre", "11/1/2025-11/30/2025",
                 "--post", "12/1/2025-12/31/2025", "--exclude", "12/25/2025", "--operator", "alpha",
                 "--out", out]) == 0
    s = spark.getActiveSession() or spark
    got = {r.metric: r for r in s.read.parquet(os.path.join(out, "combined_summary_pre_post")).collect()}
    assert got["Sales"].post == 34.0 and got["Sales"].operator == "alpha"


def test_legacy_files_stand_in_for_empty_campaigns(spark, tmpdir_fresh):
    dd = fx.dd_file(tmpdir_fresh, [["11/2/2025", "1:30 PM", "101", "a", "10", "8", "8"]])
    p = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))
    legacy = spark.createDataFrame([("pre_25", "101", 4)], "period string, store_id string, new_customers int")
    none = spark.createDataFrame([], exports.CAMPAIGN_SCHEMA)
    orders = exports.orders(spark, [dd], [])
    for campaigns in (None, none):
        t = run_report(spark, p, ReportInputs(orders=orders, campaigns=campaigns, dd_new_customers=legacy))
        assert [(r.store_id, r.pre_25) for r in t["new_customers_by_store"].collect()] == [("101", 4.0)]
    path = fx.write_csv(os.path.join(tmpdir_fresh, "MARKETING_PROMOTION_x.csv"), [["11/3/2025", "7", "True", "2", "20", "5", "3"]], fx.PROMO_HEADER)
    some = exports.campaign_fact(spark, [path], exports.PROMOTION, "promotion")
    t = run_report(spark, p, ReportInputs(orders=orders, campaigns=some, dd_new_customers=legacy))
    assert [(r.store_id, r.pre_25) for r in t["new_customers_by_store"].collect()] == [("7", 3.0)]


def test_command_line_per_platform_selection_and_daily_export(spark, tmpdir_fresh):
    from periodlens.__main__ import main
    d = tmpdir_fresh
    fx.dd_file(d, [["11/2/2025", "1:30 PM", "101", "a", "10", "8", "8"], ["12/2/2025", "7:00 PM", "102", "b", "30", "20", "20"]])
    fx.ue_file(d, [fx.ue_row("101", "u1", "12/3/2025", "11:15 AM", "4", "3"), fx.ue_row("102", "u2", "12/3/2025", "11:15 AM", "5", "3")])
    fx.write_csv(os.path.join(d, "legacy", "dd-mkt-post-25.csv"), [["12/2/2025", "101", "6"]], ["Date", "Store ID", "New customers acquired"])
    fx.write_csv(os.path.join(d, "legacy", "ue-mkt-post-25.csv"), [["9"]], ["New customers"])
    out, staging = os.path.join(d, "out"), os.path.join(d, "staging")
    assert main(["--dd", os.path.join(d, "dd-*.csv"), "--ue", os.path.join(d, "ue-*.csv"), "--pre", "11/1/2025-11/30/2025",
                 "--post", "12/1/2025-12/31/2025", "--dd-stores", "101", "--ue-stores", "102,900", "--legacy", os.path.join(d, "legacy"),
                 "--staging", staging, "--out", out]) == 0
    s = spark.getActiveSession() or spark
    got = {r.metric: r for r in s.read.parquet(os.path.join(out, "combined_summary_pre_post")).collect()}
    assert (got["Sales"].pre, got["Sales"].post, got["New Customers"].post) == (10.0, 5.0, 15.0)
    daily = s.read.parquet(os.path.join(out, "daily")).where("metric = 'Sales'")
    assert sorted(r.value for r in daily.collect()) == [4.0, 5.0, 10.0, 30.0]
    counts = {r.platform: r.selected_stores for r in s.read.parquet(os.path.join(out, "store_coverage")).collect()}
    assert counts == {"DD": 1, "UE": 2}
    text = {r.metric: r.post for r in s.read.parquet(os.path.join(out, "combined_summary_pre_post_text")).collect()}
    assert text["Sales"] == "$5.0"
    assert not os.listdir(os.path.join(staging, "periodlens"))
