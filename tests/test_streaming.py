"""Incremental landing of export drops (file stream source, exactly once)."""

import os

from periodlens.sources import specs
from periodlens.streaming.landing import land_orders, read_landed
from tests import csvfix as fx


def test_landing_is_incremental_and_idempotent(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drop")
    fx.dd_file(src, [["11/1/2025", "1:00 PM", "101", "a", "10", "8", "8"],
                     ["11/2/2025", "1:00 PM", "NA", "b", "10", "8", "8"]], name="a.csv")
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    q = land_orders(spark, src, specs.DD_ORDERS, out, ckpt)
    q.awaitTermination(120)
    assert read_landed(spark, out).count() == 1
    fx.dd_file(src, [["2025-12-01", "", "102", "c", "5", "4", "4"]], name="b.csv")   # ISO file
    q = land_orders(spark, src, specs.DD_ORDERS, out, ckpt)
    q.awaitTermination(120)
    landed = read_landed(spark, out)
    assert sorted(r.order_id for r in landed.collect()) == ["a", "c"]
    assert sorted(r.event_month for r in landed.select("event_month").distinct().collect()) == \
        ["2025-11", "2025-12"]
    q = land_orders(spark, src, specs.DD_ORDERS, out, ckpt)          # nothing new
    q.awaitTermination(120)
    assert read_landed(spark, out).count() == 2


def test_landing_ue_with_banner(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "ue")
    fx.ue_file(src, [fx.ue_row("s1", "u1", "11/2/2025", "1:11 AM", "10", "7")])
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    q = land_orders(spark, src, specs.UE_ORDERS, out, ckpt)
    q.awaitTermination(120)
    rows = read_landed(spark, out).collect()
    assert [(r.store_id, r.minute_of_day) for r in rows] == [("s1", 71)]


def test_read_landed_prunes_months(spark, tmpdir_fresh):
    from periodlens import ReportParams
    src = os.path.join(tmpdir_fresh, "drop")
    fx.dd_file(src, [["11/1/2025", "", "101", "a", "10", "8", "8"],
                     ["3/1/2025", "", "101", "b", "10", "8", "8"]], name="a.csv")
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    land_orders(spark, src, specs.DD_ORDERS, out, ckpt).awaitTermination(120)
    p = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))
    df = read_landed(spark, out, p)
    assert [r.order_id for r in df.collect()] == ["a"]
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    line = [ln for ln in plan.splitlines() if ln.startswith("PartitionFilters")][0]
    assert "event_month" in line and "2025-11" in line


def test_landing_campaign_files(spark, tmpdir_fresh):
    from periodlens import ReportParams
    from periodlens.operators import marketing
    from periodlens.streaming.landing import land_campaigns
    src = os.path.join(tmpdir_fresh, "promo")
    fx.write_csv(os.path.join(src, "MARKETING_PROMOTION_a.csv"),
                 [["12/2/2025", "101", "True", "2", "20", "5", "3"],
                  ["12/3/2025", "102", "false", "1", "10", "0", "1"]], fx.PROMO_HEADER)
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    land_campaigns(spark, src, specs.PROMOTION, "promotion", out, ckpt).awaitTermination(120)
    landed = spark.read.parquet(out).drop("batch_id")
    p = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))
    t = {r.campaign_key: r for r in marketing.campaign_table(landed, p, "promotion").collect()}
    assert (t["True"].sales, t["false"].campaign_label) == (20.0, "Corporate")


def test_landing_resolves_each_files_own_header(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "drop")
    fx.dd_file(src, [["11/1/2025", "", "101", "a", "100", "80", "80"]], name="a.csv")
    swapped = [*fx.DD_HEADER[:4], fx.DD_HEADER[5], fx.DD_HEADER[4], fx.DD_HEADER[6]]
    fx.dd_file(src, [["11/2/2025", "", "101", "b", "80", "100", "80"]], name="b.csv", header=swapped)
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    land_orders(spark, src, specs.DD_ORDERS, out, ckpt).awaitTermination(120)
    assert sorted((r.order_id, float(r.sales), float(r.payouts)) for r in read_landed(spark, out).collect()) == [
        ("a", 100.0, 80.0), ("b", 100.0, 80.0)]


def test_undated_rows_are_landed_and_read(spark, tmpdir_fresh):
    from periodlens import ReportParams
    from periodlens.streaming.landing import land_campaigns
    src = os.path.join(tmpdir_fresh, "promo")
    fx.write_csv(os.path.join(src, "MARKETING_PROMOTION_a.csv"), [["101", "True", "2", "20", "5"]], fx.PROMO_HEADER[1:6])
    out, ckpt = os.path.join(tmpdir_fresh, "landed"), os.path.join(tmpdir_fresh, "ckpt")
    land_campaigns(spark, src, specs.PROMOTION, "promotion", out, ckpt, undated="keep").awaitTermination(120)
    p = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))
    assert [r.undated for r in read_landed(spark, out, p).collect()] == [True]
