"""One pinned test per remaining gotcha row of the survey."""

import datetime as dt
from dataclasses import replace
import os
from decimal import Decimal

from periodlens import ReportParams
from periodlens.operators import compare, facts, insights, marketing, summary
from periodlens.plans.report import ReportInputs, run_report
from periodlens.sources import exports, files
from tests import csvfix as fx
from tests.test_exports import _marketing_tree

D = dt.date
P = ReportParams.of(pre=(D(2025, 11, 1), D(2025, 11, 30)), post=(D(2025, 12, 1), D(2025, 12, 31)))
SCHEMA = ("platform string, store_id string, order_id string, event_date date, event_ts timestamp_ntz, "
          "minute_of_day int, sales decimal(18,4), payouts decimal(18,4)")


def fact(spark, rows):
    return spark.createDataFrame(
        [(p, s, o, d, ts or dt.datetime.combine(d, dt.time()), 0, Decimal(a), Decimal(a))
         for p, s, o, d, ts, a in rows], SCHEMA)


def test_g3_calendar_date_by_default_strict_midnight_on_request(spark):
    late = dt.datetime(2025, 12, 31, 18, 30)
    f = fact(spark, [("DD", "1", "a", late.date(), late, 5)])
    assert compare.store_compare(f, P, ["sales"]).collect()[0].post_25 == 5.0
    strict = replace(P, end_at_midnight=True)
    assert facts.report_rows(f, strict).count() == 0


def test_g7_dd_new_customers_ignore_store_selection(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), None, 5)])
    nc = spark.createDataFrame([("promotion", "99", "k", D(2025, 11, 3), Decimal(4))],
                               "channel string, store_id string, campaign_key string, event_date date, "
                               "new_customers decimal(18,4)")
    nc_dec = summary.new_customers_dec(nc, P)
    rows = {r.metric: r for r in summary.platform_summary(compare.store_compare_dec(f, P), ["1"], nc_dec)
            .collect()}
    assert rows["New Customers"].pre == 4.0          # store 99 is not selected but still counted


def test_g14_insights_use_all_stores(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), None, 5), ("DD", "2", "b", D(2025, 11, 2), None, 7)])
    c = compare.store_compare_dec(f, P)
    assert {r.platform: r.pre for r in insights.platform_movers(c).collect()} == {"DD": 12.0}
    assert {r.metric: r.pre for r in summary.platform_summary(c, ["1"]).collect()}["Sales"] == 5.0


def test_g15_store_ids_stay_text(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "", "0101", "a", "1", "1", "1"]])
    assert exports.dd_orders(spark, [path]).collect()[0].store_id == "0101"


def test_g16_combined_campaign_rows_ordered_by_key(spark, tmpdir_fresh):
    mk = _marketing_tree(tmpdir_fresh)
    both = exports.promotions(spark, mk).unionByName(exports.sponsored(spark, mk))
    keys = [r.campaign_key for r in marketing.campaign_combined(both, P).collect()]
    assert keys == sorted(keys)


def test_g17_first_file_per_folder_on_request(spark, tmpdir_fresh):
    mk = _marketing_tree(tmpdir_fresh)
    sub = [d for d in files.dirs(spark, os.path.join(mk, "marketing_*"))][0]
    fx.write_csv(os.path.join(sub.replace("file:", ""), "MARKETING_PROMOTION_2.csv"),
                 [["12/7/2025", "104", "True", "1", "1", "1", "1"]], fx.PROMO_HEADER)
    every = exports.marketing_files(spark, mk)
    first = exports.marketing_files(spark, mk, first_per_folder=True)
    assert len(every) == 3 and len(first) == 2


def test_g20_platform_without_rows_still_reports(spark, tmpdir_fresh):
    dd = fx.dd_file(tmpdir_fresh, [["11/2/2025", "1:30 PM", "101", "a", "10", "8", "8"]])
    t = run_report(spark, P, ReportInputs(orders=exports.orders(spark, [dd], [])), run_id="g20")
    slots_ue = [r for r in t["slot_sales_pre_post"].collect() if r.platform == "UE"]
    assert len(slots_ue) == 6 and all(r.post == 0.0 for r in slots_ue)
    assert t["daily_cube"].where("platform = 'UE'").count() == 0


def test_g21_dd_store_fallback_in_every_report(spark, tmpdir_fresh):
    header = ["Timestamp local date", "Store ID", "DoorDash order ID", "Subtotal", "Net total"]
    path = fx.dd_file(tmpdir_fresh, [["11/2/2025", "7", "a", "3", "2"]], header=header)
    f = exports.dd_orders(spark, [path])
    from periodlens.operators import daily
    assert daily.daily_store(f, P, "sales").collect()[0].store_id == "7"
    assert compare.store_compare(f, P, ["sales"]).collect()[0].store_id == "7"
