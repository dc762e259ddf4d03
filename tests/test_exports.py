"""CSV export scans and cleaning (S1-S10, C1-C18) on invented messy files."""

import datetime as dt
import os

import pytest

from periodlens import ReportParams
from periodlens.operators import compare, marketing, summary
from periodlens.sources import exports, files, specs
from tests import csvfix as fx

P = ReportParams.of(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def test_dd_scan_cleans_values(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [
        ["11/1/2025", "1:11 AM", "101", "o1", "10.50", "8.00", "7.00"],
        ["11/1/2025", "1:11 AM", "101", "o1", "1,200.5", "abc", ""],   # same order, bad money
        ["11/2/2025", "13:45", "101", "o2", "NaN", "1.5d", "2"],
        ["11/3/2025", "9:00 PM", "NA", "o3", "5", "5", "5"],           # NA store -> dropped
        ["11/3/2025", "9:00 PM", "", "o4", "5", "5", "5"],             # empty store -> dropped
        ["12/5/2025", "12:00 PM", " 102 ", "o5", "20", "15", "14"],
        ["2025-12-06", "12:00 PM", "102", "o6", "99", "99", "99"],     # minority ISO row -> dropped
    ])
    f = exports.dd_orders(spark, [path])
    got = rows(f, "store_id", "order_id", "event_date", "sales", "payouts", "minute_of_day")
    assert [g[0] for g in got] == ["101", "101", "101", "102"]
    by_order = {(g[1], str(g[3])) for g in got}
    assert ("o1", "10.5000") in by_order and ("o1", "None") in by_order
    assert all(g[2] != dt.date(2025, 12, 6) for g in got)
    minutes = {g[1]: g[5] for g in got if g[5] is not None}
    assert minutes["o2"] == 13 * 60 + 45 and minutes["o5"] == 12 * 60
    assert min(g[5] for g in got if g[1] == "o1") == 71


def test_dd_all_iso_file_parses(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["2025-11-02", "", "7", "a", "1", "1", "1"],
                                     ["2025-12-02", "", "7", "b", "2", "2", "2"]])
    f = exports.dd_orders(spark, [path])
    assert rows(f, "event_date") == [(dt.date(2025, 11, 2),), (dt.date(2025, 12, 2),)]


def test_date_format_is_chosen_per_file(spark, tmpdir_fresh):
    a = fx.dd_file(tmpdir_fresh, [["11/4/2025", "", "1", "a", "1", "1", "1"]], name="a.csv")
    b = fx.dd_file(tmpdir_fresh, [["2025-11-05", "", "1", "b", "1", "1", "1"]], name="b.csv")
    f = exports.dd_orders(spark, [a, b])
    assert rows(f, "order_id", "event_date") == [("a", dt.date(2025, 11, 4)), ("b", dt.date(2025, 11, 5))]


def test_ue_banner_and_positional_columns(spark, tmpdir_fresh):
    path = fx.ue_file(tmpdir_fresh, [
        fx.ue_row("s1", "u1", "11/2/2025", "1:11 AM", "10", "7"),
        fx.ue_row("s1", "u2", "2025-11-03", "11:00 AM", "5", "4"),      # per-row cascade keeps it
        fx.ue_row("s2", "u3", "12/2/2025", "7:19 PM", "3", "2"),
    ])
    f = exports.ue_orders(spark, [path])
    got = rows(f, "store_id", "order_id", "event_date", "minute_of_day")
    assert got == [("s1", "u1", dt.date(2025, 11, 2), 71), ("s1", "u2", dt.date(2025, 11, 3), 660),
                   ("s2", "u3", dt.date(2025, 12, 2), 19 * 60 + 19)]


def test_shop_id_header_is_accepted(spark, tmpdir_fresh):
    header = list(fx.UE_HEADER)
    header[0] = "Shop ID"
    path = fx.write_csv(os.path.join(tmpdir_fresh, "ue.csv"),
                        [fx.ue_row("s9", "x", "11/9/2025", "", "1", "1")], header, fx.UE_BANNER)
    assert rows(exports.ue_orders(spark, [path]), "store_id") == [("s9",)]


def test_missing_required_column_raises(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "1", "1"]],
                      header=["Timestamp local date", "Merchant store ID", "Subtotal"])
    with pytest.raises(specs.MissingColumn):
        exports.dd_orders(spark, [path])


def test_store_compare_from_csv(spark, tmpdir_fresh):
    dd = fx.dd_file(tmpdir_fresh, [
        ["11/1/2024", "", "101", "a", "10", "8", "8"],      # pre_24
        ["12/1/2024", "", "101", "b", "20", "16", "16"],    # post_24
        ["11/1/2025", "", "101", "c", "30", "24", "24"],    # pre_25
        ["11/1/2025", "", "101", "c", "5", "4", "4"],       # same order
        ["12/1/2025", "", "101", "d", "50", "40", "40"],    # post_25
        ["12/2/2025", "", "102", "e", "7", "6", "6"],       # store only in post
    ])
    ue = fx.ue_file(tmpdir_fresh, [fx.ue_row("101", "u1", "12/3/2025", "", "4", "3")])
    fact = exports.orders(spark, [dd], [ue])
    c = compare.store_compare(fact, P)
    got = {(r.platform, r.store_id, r.metric): r for r in c.collect()}
    s = got[("DD", "101", "sales")]
    assert (s.pre_24, s.post_24, s.pre_25, s.post_25) == (10.0, 20.0, 35.0, 50.0)
    assert (s.prevs_post, s.last_year_pre_vs_post, s.yoy) == (15.0, 10.0, 30.0)
    assert s.growth_pct == round(15 / 35 * 100, 1)
    assert got[("DD", "101", "orders")].pre_25 == 1.0
    z = got[("DD", "102", "sales")]
    assert (z.pre_25, z.post_25, z.growth_pct) == (0.0, 7.0, 700.0)   # divide by 1 (M2)
    assert got[("UE", "101", "sales")].post_25 == 4.0


def _marketing_tree(root):
    mk = os.path.join(root, "marketing_data")
    sub = os.path.join(mk, "marketing_2025-11-01_2025-12-31")
    fx.write_csv(os.path.join(sub, "MARKETING_PROMOTION_1.csv"), [
        ["11/2/2025", "101", "True", "2", "20", "5", "3"],
        ["12/2/2025", "101", "false", "1", "10", "0", "1"],
        ["12/3/2025", "102", "0", "3", "30", "10", "2"],
        ["12/4/2025", "102", "other", "0", "5", "1", ""],
        ["12/5/2025", "102", "", "4", "4", "4", "4"],
    ], fx.PROMO_HEADER)
    fx.write_csv(os.path.join(mk, "MARKETING_PROMOTION_root.csv"), [
        ["12/6/2025", "103", "True", "1", "8", "2", "5"],
    ], ["Date", "Shop ID", "Is self serve campaign", "Orders", "Sales",
        "Customer discounts from marketing | (Funded by you)", "NEW CUSTOMERS ACQUIRED"])
    fx.write_csv(os.path.join(sub, "MARKETING_SPONSORED_LISTING_1.csv"), [
        ["12/2/2025", "101", "True", "2", "40", "4"],
        ["12/9/2025", "102", "False", "0", "0", "0"],
    ], fx.SPONSORED_HEADER)
    return mk


def test_marketing_files_once_each(spark, tmpdir_fresh):
    mk = _marketing_tree(tmpdir_fresh)
    # a base that holds marketing_* folders is the root itself
    assert exports.marketing_root(spark, tmpdir_fresh).rstrip("/").endswith(os.path.basename(tmpdir_fresh))
    assert exports.marketing_root(spark, mk).rstrip("/").endswith("marketing_data")
    got = [files.basename(p) for p in exports.marketing_files(spark, mk)]
    assert got == ["MARKETING_PROMOTION_root.csv", "MARKETING_PROMOTION_1.csv"] or \
        sorted(got) == sorted(["MARKETING_PROMOTION_root.csv", "MARKETING_PROMOTION_1.csv"])


def test_campaign_tables_from_csv(spark, tmpdir_fresh):
    mk = _marketing_tree(tmpdir_fresh)
    promo = exports.promotions(spark, mk)
    t = {r.campaign_key: r for r in marketing.campaign_table(promo, P, "promotion").collect()}
    assert set(t) == {"True", "false", "0", "other"}          # empty key dropped (G22)
    assert t["false"].campaign_label == "Corporate" and t["0"].campaign_label == "Corporate"
    assert t["True"].campaign_label == "TODC" and t["other"].campaign_label == "other"
    assert t["false"].roas == 0.0 and t["other"].cost_per_order == 0.0   # zero rules (M7)
    assert t["0"].roas == 3.0 and t["0"].cost_per_order == pytest.approx(10 / 3)
    both = promo.unionByName(exports.sponsored(spark, mk))
    comb = {r.campaign_key: r for r in marketing.campaign_combined(both, P).collect()}
    assert comb["True"].sales == 8.0 + 40.0


def test_new_customers_from_csv(spark, tmpdir_fresh):
    mk = _marketing_tree(tmpdir_fresh)
    nc = {r.store_id: r for r in summary.new_customers_by_store(exports.promotions(spark, mk), P).collect()}
    assert nc["101"].pre_25 == 3.0 and nc["101"].post_25 == 1.0
    assert nc["102"].post_25 == 2.0 + 4.0                       # empty value is null, not 0
    assert nc["103"].post_25 == 5.0                             # case-variant header resolved per file


def test_legacy_marketing_files(spark, tmpdir_fresh):
    d = tmpdir_fresh
    by_period = {}
    for i, p in enumerate(["pre_24", "post_24", "pre_25", "post_25"]):
        by_period[p] = fx.write_csv(os.path.join(d, f"dd-mkt-{p}.csv"),
                                    [["11/2/2025", "101", str(i + 1)], ["11/30/2025", "101", "100"]],
                                    ["Date", "Store ID", "New customers acquired"])
    nc = exports.legacy_dd_new_customers(spark, by_period, excluded=[dt.date(2025, 11, 30)])
    assert rows(nc, "period", "new_customers") == sorted(
        [(p, v) for p, v in zip(["pre_24", "post_24", "pre_25", "post_25"],
                                [__import__("decimal").Decimal(f"{i}.0000") for i in range(1, 5)])])
    ue = {p: fx.write_csv(os.path.join(d, f"ue-mkt-{p}.csv"), [["4"], ["6"]], ["New customers"])
          for p in ["pre_25", "post_25"]}
    tot = {r.period: float(r.new_customers) for r in exports.legacy_ue_new_customer_totals(spark, ue).collect()}
    assert tot == {"pre_25": 10.0, "post_25": 10.0}


def test_profile(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "", "1", "a", "1", "1", "1"],
                                     ["11/9/2025", "", "1", "b", "1", "1", "1"]])
    r = exports.profile(spark, [path], specs.DD_ORDERS).collect()[0]
    assert (r.rows, r.start_date, r.end_date, r.date_column_found) == (
        2, dt.date(2025, 11, 1), dt.date(2025, 11, 9), True)
    assert r.columns.startswith("Timestamp local date, Timestamp local time, Merchant store ID")


def test_upload_grouping(spark, tmpdir_fresh):
    names = ["MARKETING_PROMOTION_2025-11-01_2025-11-30.csv", "MARKETING_PROMOTION_x.csv", "notes.csv", "marketing_a_b_c_d_e.csv"]
    for n in names:
        fx.write_csv(os.path.join(tmpdir_fresh, "up", n), [["x"]])
    got = {r.path.rsplit("/", 1)[1]: r.upload_group for r in files.uploads(spark, os.path.join(tmpdir_fresh, "up")).collect()}
    assert [got[n] for n in names] == ["marketing_2025-11-01_2025-11-30", "marketing_MARKETING_PROMOTION_x", "marketing_uploaded",
                                       "marketing_marketing_a_b_c"]


def test_observation_counts_dropped_rows(spark, tmpdir_fresh):
    from pyspark.sql import Observation
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "", "1", "a", "1", "1", "1"],
                                     ["not a date", "", "1", "b", "1", "1", "1"],
                                     ["11/2/2025", "", "", "c", "1", "1", "1"]])
    obs = Observation("parse")
    assert exports.order_fact(spark, [path], specs.DD_ORDERS, obs).count() == 1
    got = obs.get
    assert (got["rows_read"], got["rows_without_date"], got["rows_without_store"]) == (3, 1, 1)


def test_period_files_and_historical_payouts(spark, tmpdir_fresh):
    from periodlens.operators import daily
    a = fx.dd_file(tmpdir_fresh, [["11/3/2024", "", "1", "a", "10", "8", "7"]], name="pre24.csv")
    b = fx.dd_file(tmpdir_fresh, [["11/3/2025", "", "1", "b", "10", "8", "7"]], name="pre25.csv")
    f = exports.orders_by_period_files(spark, {"pre_24": a, "pre_25": b}, specs.DD_ORDERS)
    assert rows(f, "period", "order_id") == [("pre_24", "a"), ("pre_25", "b")]
    cells = {r.period: float(r.payouts) for r in daily.daily_cells_dec(f, P).collect()}
    assert cells == {"pre_24": 7.0, "pre_25": 8.0}          # C6


def test_approx_orders_option(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["11/3/2025", "", "1", o, "1", "1", "1"] for o in "abcab"])
    c = compare.store_compare(exports.dd_orders(spark, [path]), P, ["orders"], approx_orders=True)
    assert c.collect()[0].pre_25 == 3.0


def test_undated_campaign_files(spark, tmpdir_fresh):
    path = fx.write_csv(os.path.join(tmpdir_fresh, "MARKETING_PROMOTION_x.csv"),
                        [["101", "True", "2", "20", "5"]],
                        ["Store ID", "Is self serve campaign", "Orders", "Sales",
                         "Customer discounts from marketing | (Funded by you)"])
    with pytest.raises(specs.MissingColumn):
        exports.campaign_fact(spark, [path], specs.PROMOTION, "promotion")
    kept = exports.campaign_fact(spark, [path], specs.PROMOTION, "promotion", undated="keep")
    t = marketing.campaign_table(kept, P, "promotion").collect()
    assert [(r.campaign_key, r.sales) for r in t] == [("True", 20.0)]


def test_files_with_other_column_order_keep_their_values(spark, tmpdir_fresh):
    a = fx.dd_file(tmpdir_fresh, [["11/4/2025", "", "1", "a", "100", "80", "80"]], name="a.csv")
    swapped = [*fx.DD_HEADER[:4], fx.DD_HEADER[5], fx.DD_HEADER[4], fx.DD_HEADER[6]]
    b = fx.dd_file(tmpdir_fresh, [["11/5/2025", "", "2", "b", "80", "100", "80"]], name="b.csv", header=swapped)
    f = exports.order_fact(spark, [a, b], specs.DD_ORDERS)
    assert sorted((r.order_id, float(r.sales), float(r.payouts)) for r in f.collect()) == [("a", 100.0, 80.0), ("b", 100.0, 80.0)]


def test_banner_text_makes_no_layout_of_its_own(spark, tmpdir_fresh):
    paths = [fx.write_csv(os.path.join(tmpdir_fresh, f"ue-{i}.csv"), [fx.ue_row("s", f"u{i}", "11/2/2025", "1:11 AM", "10", "7")],
                          fx.UE_HEADER, [f"Report {i}", *["x"] * (i % 2)]) for i in range(4)]
    assert len(exports.layouts(spark, paths, 2)) == 1
    assert exports.ue_orders(spark, paths).count() == 4


@pytest.mark.parametrize("text,date", [
    ("11/1/2025 13:05", "2025-11-01"), ("11/01/2025 1:05 PM", "2025-11-01"), ("Nov 1, 2025", "2025-11-01"), ("2025/11/01", "2025-11-01"),
    ("20251101", "2025-11-01"), ("November 1, 2025 1:05 pm", "2025-11-01"), ("1 Nov 2025", "2025-11-01"), ("2025-11-01T13:05:00", "2025-11-01"),
    ("2025-11-01 1:05 PM", "2025-11-01"), ("11/1/2025", "2025-11-01"), ("soon", None), ("1101", None), ("13/45/2025", None), ("", None)])
def test_generic_dates(spark, text, date):
    from pyspark.sql import functions as F

    from periodlens.functions import dates
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(dates.parse_date_per_row("t").alias("d"), F.date_format(dates.parse_timestamp("t"), "HH:mm").alias("c")).first()
    assert (r.d.isoformat() if r.d else None) == date
    if date and ":" in text:
        assert r.c == "13:05"


@pytest.mark.parametrize("text,minute", [("1:11 AM", 71), ("1:11:05 AM", 71), ("11/1/2025 1:05 PM", 785), ("11/1/2025 13:05", 785), ("13:05", 785),
                                         ("2025-11-01 13:05:09", 785), ("1:05pm", 785), ("noon", None), (None, None)])
def test_clock_times(spark, text, minute):
    from periodlens.functions import dates
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(dates.minute_of_day("t").alias("m")).first().m == minute


def test_required_columns(spark, tmpdir_fresh):
    no_id = [h for h in fx.UE_HEADER if h != "Order ID"] + ["Extra"]
    ue = fx.write_csv(os.path.join(tmpdir_fresh, "ue.csv"), [["x"] * len(no_id)], no_id, fx.UE_BANNER)
    with pytest.raises(specs.MissingColumn):
        exports.ue_orders(spark, [ue])
    no_spend = fx.write_csv(os.path.join(tmpdir_fresh, "sp.csv"), [["12/2/2025", "1", "True", "2", "20"]], fx.SPONSORED_HEADER[:5])
    with pytest.raises(specs.MissingColumn):
        exports.campaign_fact(spark, [no_spend], specs.SPONSORED, "sponsored")


def test_end_at_midnight_on_an_export(spark, tmpdir_fresh):
    path = fx.ue_file(tmpdir_fresh, [fx.ue_row("1", "a", "12/31/2025 6:30 PM", "6:30 PM", "10", "8"), fx.ue_row("1", "b", "12/31/2025", "", "1", "1")])
    f = exports.ue_orders(spark, [path])
    days = dict(pre=("11/1/2025", "11/30/2025"), post=("12/1/2025", "12/31/2025"))
    both = compare.store_compare(f, ReportParams.of(**days), ["sales"]).first()
    strict = compare.store_compare(f, ReportParams.of(**days, end_at_midnight=True), ["sales"]).first()
    assert (both.post_25, strict.post_25) == (11.0, 1.0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_read_once(spark, tmpdir_fresh):
    """Both layouts come from one CSV scan; facts, votes and headers read the staged cells."""
    a = fx.dd_file(tmpdir_fresh, [["11/4/2025", "", "1", "a", "100", "80", "80"]], name="a.csv")
    b = fx.dd_file(tmpdir_fresh, [["5", "2025-11-05", "2", "b", "80", "100", "80"]], name="b.csv", header=["Net total", *fx.DD_HEADER[:1], *fx.DD_HEADER[2:5], "x", "y"])
    assert _plan(exports.raw_cells(spark, [a, b])).count("FileScan csv") == 1
    p = _plan(exports.order_fact(spark, [a, b], specs.DD_ORDERS))
    assert "FileScan csv" not in p and p.count("FileScan parquet") == 2  # typed rows, and the vote over their date columns


def test_rejected_rows_by_reason(spark, tmpdir_fresh):
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "", "1", "a", "1", "1", "1"], ["2025-11-01", "", "1", "b", "1", "1", "1"], ["soon", "", "", "c", "1", "1", "1"],
                                     ["", "", "1", "d", "1", "1", "1"], ["NA", "", "1", "e", "1", "1", "1"], ["11/2/2025", "", "null", "f", "1", "1", "1"]])
    rows_ = exports.order_rows(spark, [path], specs.DD_ORDERS)
    assert rows(exports.rejects(rows_), "reject_reason", "rows") == [
        (exports.OTHER_FORMAT, 1), (exports.NO_DATE, 2), (exports.NO_STORE, 1), (exports.UNREADABLE_DATE, 1)]
    assert exports.facts_of(rows_).count() == 1 and exports.rejects(exports.order_rows(spark, [], specs.DD_ORDERS)).count() == 0


def test_wide_header_only_files_and_marks(spark, tmpdir_fresh):
    """A header wider than expected is read again with more columns; a byte-order mark is no part of a name;
    empty files and files of headers alone give no rows."""
    wide = [f"h{i}" for i in range(150)]
    a = fx.write_csv(os.path.join(tmpdir_fresh, "wide.csv"), [["x"] * 150 + ["11/4/2025", "1", "a", "1", "1", "1"]],
                     [*wide, "﻿Timestamp local date", *fx.DD_HEADER[2:]])
    b = fx.write_csv(os.path.join(tmpdir_fresh, "bom.csv"), [["11/5/2025", "", "2", "b", "2", "2", "2"]], ["﻿" + fx.DD_HEADER[0].strip(), *fx.DD_HEADER[1:]])
    c = fx.dd_file(tmpdir_fresh, [], name="head.csv")
    open(os.path.join(tmpdir_fresh, "empty.csv"), "w").close()
    f = exports.order_fact(spark, [a, b, c, os.path.join(tmpdir_fresh, "empty.csv")], specs.DD_ORDERS)
    assert rows(f, "order_id") == [("a",), ("b",)]
    prof = {r._src_file.rsplit("/", 1)[1]: r.rows for r in exports.profile(spark, [b, c], specs.DD_ORDERS).collect()}
    assert prof == {"bom.csv": 1, "head.csv": 0}


def test_large_file_in_many_splits(spark, tmpdir_fresh):
    """Header lines are the first lines of the file, whatever the splits."""
    path = fx.ue_file(tmpdir_fresh, [fx.ue_row(f"s{i % 7}", f"u{i}", "11/2/2025", "1:11 AM", str(i), "7") for i in range(30_000)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert exports.raw_cells(spark, [path]).rdd.getNumPartitions() > 5
        f = exports.ue_orders(spark, [path])
        assert f.count() == 30_000 and int(f.agg({"sales": "sum"}).first()[0]) == sum(range(30_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_cells_are_streamed_and_only_file_tables_broadcast(spark, tmpdir_fresh):
    """A long column of few values is a small Parquet file; its rows still do not go to the driver."""
    paths = {p: fx.write_csv(os.path.join(tmpdir_fresh, f"ue-{p}.csv"), [[i % 2] for i in range(20000)], header=["New customers"]) for p in ("pre", "post")}
    landed = exports.land(spark, list(paths.values()), 1)
    plan = landed.rows._jdf.queryExecution().executedPlan()
    assert landed.rows.count() == 40000
    built = [ln for ln in plan.toString().splitlines() if "HashJoin" in ln and "_block" in ln]
    assert built and all("BuildRight" in ln for ln in built), plan.toString()
    got = exports.legacy_ue_new_customer_totals(spark, paths)
    assert rows(got.selectExpr("period", "CAST(new_customers AS INT) AS n"), "period", "n") == [("post", 10000), ("pre", 10000)]


def test_short_lines_are_no_errors(spark, tmpdir_fresh):
    """The scan's schema is pruned, so lines of fewer cells are filled with nulls and longer ones cut, without an error for each."""
    path = os.path.join(tmpdir_fresh, "a.csv")
    with open(path, "w") as f:
        f.write('a,b\n1,"x,y"\n\n2\n1,2,3,4,5,6\n')
    raw = exports.raw_cells(spark, [path], 3)
    scan = [ln for ln in raw._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan csv" in ln][0]
    assert "ReadSchema: struct<c0:string,c1:string,c2:string,c3:string>" in scan
    assert raw._jdf.queryExecution().analyzed().collectLeaves().head().relation().dataSchema().size() > 4
    assert rows(raw, "c0", "c1", "c2", "c3") == [("1", "2", "3", "4"), ("1", "x,y", None, None), ("2", None, None, None), ("a", "b", None, None)]


ODD_DATES = ["1/5/2025", "01/05/2025", " 2/3/2025 ", "2025-1-5", "2025-01-05", "20250105", "2025/1/5", "Jan 5, 2025", "january 5 2025", "5 Jan 2025", "5-Jan-2025", "31/1/2025",
             "2/30/2025", "2025-02-30", "-5-1-1", "5 jan  2025", "1/5/2025 1:11 AM", "2025-01-05T13:11:05", "2025-01-05 25:00", "Jan 5, 2025 1:11 PM", "1:11 AM", "13:11", "soon",
             "1/2", "-", "/", "a b c", "5 Foo 2025", "2025", "", None, "2025-01-05 13:11:05.123456", "+12025-01-05", "1/5/12025"]


def test_text_of_another_format_does_not_reach_a_parser(spark):
    """Parsers see only text that may be of their format, with the values that they give alone."""
    from periodlens.functions import dates
    df = spark.createDataFrame([(t,) for t in ODD_DATES], "t string")
    plain = {"us": "try_to_date(trim(t), 'M/d/yyyy')", "iso": "try_to_date(trim(t), 'yyyy-M-d')", "named": "try_to_date(initcap(trim(t)), 'd MMM yyyy')"}
    own = {"us": dates._us("t"), "iso": dates._iso("t"), "named": dates._parsed("initcap(trim(t))", dates.NAMED_DATE)}
    assert all(sql.startswith("CASE WHEN") for sql in own.values())
    for k, sql in own.items():
        assert df.where(f"NOT ({sql}) <=> ({plain[k]})").collect() == [], k
    typed = dates.date_candidates(df, "t").withColumn("alone", dates.parse_timestamp("t"))
    assert typed.where("NOT _ts <=> alone").collect() == []
    clocks = dates.with_minute_of_day(df, "t", "m").withColumn("alone", dates.minute_of_day("t"))
    assert clocks.where("NOT m <=> alone").collect() == []


def test_vote_of_files_is_broadcast(spark):
    from periodlens.functions import dates
    df = spark.range(1000).selectExpr("concat('f', id % 3) AS _src_file", "'1/5/2025' AS t")
    plan = dates.date_of_file(dates.date_candidates(df, "t").hint("merge"), "d").where("d IS NOT NULL")
    assert "ResolvedHint (strategy=broadcast)" in plan._jdf.queryExecution().analyzed().toString() and plan.count() == 1000


def test_exports_are_written_whole_without_sorting(spark, tmpdir_fresh, monkeypatch):
    """One file per name, its banner and header on top, its lines below, dealt by number and not sorted."""
    from pyspark.sql import DataFrame
    from periodlens.sources import textexports as tx
    monkeypatch.setattr(DataFrame, "sortWithinPartitions", None)
    data = spark.range(0, 3000, 1, 5).selectExpr("id % 30 AS f", "id").repartition(7)
    lines = tx._lines(data, "concat('sub ', f % 3, '/f=', f, '.csv')", {0: [("A,a", "id")], 1: [("B", "id"), ("A", "f")]}, "CAST(f % 2 AS INT)", "banner")
    paths = tx.write_lines(lines, os.path.join(tmpdir_fresh, "out"))
    assert len(paths) == len(set(paths)) == 30
    for f in range(30):
        with open(os.path.join(tmpdir_fresh, "out", f"sub {f % 3}", f"f={f}.csv")) as h:
            banner, head, *rest = h.read().splitlines()
        assert (banner, head) == ("banner", "B,A" if f % 2 else '"A,a"')
        assert sorted(rest) == sorted(f"{i},{f}" if f % 2 else str(i) for i in range(f, 3000, 30))
    assert tx.write_lines(lines.where("false"), os.path.join(tmpdir_fresh, "none")) == []


def test_parsers_are_compiled(spark, tmpdir_fresh, monkeypatch):
    """No method made for typed rows has more than 8,000 bytes: the JVM interprets larger ones for every row."""
    import re
    from periodlens.staging import Staging
    path = fx.dd_file(tmpdir_fresh, [["11/1/2025", "1:11 AM", "101", "o1", "10.50", "8.00", "7.00"]])
    put, sizes = Staging.put, {}

    def watched(self, df, name="table"):
        code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes[name] = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        return put(self, df, name)

    monkeypatch.setattr(Staging, "put", watched)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert exports.order_rows(spark, [path], specs.DD_ORDERS, Staging(spark)).count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes["typed"]) > 1 and max(sizes["typed"]) < 8000


def test_clock_groups_are_cut_by_one_match(spark):
    """Also behind line ends, colons in the date part and text that holds what a cut text looks like."""
    from periodlens.functions import dates
    texts = [day + sep + clock + end for day in ("1/5/2025", "Mar 5, 1998", "", "1:2:3:4", "::::") for sep in (" ", "T", ", ", "\n", "")
             for clock in ("1:11 AM", "13:11", "13:11:05", "1:11:05.123 pm", "25:00", "1:1", "") for end in ("", "\n", "\r\n", "x")]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for step, alone in ((dates.with_timestamp, dates.parse_timestamp), (dates.with_minute_of_day, dates.minute_of_day)):
        both = step(df, "t", "a").withColumn("b", alone("t"))
        assert both.where("a IS NOT NULL").count() > 30 and both.where("NOT a <=> b").collect() == []
    assert "regexp_extract(" not in dates.with_minute_of_day(df, "t", "a")._jdf.queryExecution().analyzed().toString()


def test_lines_and_heads_read_only_their_rows(spark, tmpdir_fresh):
    """The rows are read once for the heads of all variants, and once a variant for the lines."""
    from periodlens.sources import textexports as tx
    spark.range(50).selectExpr("id % 4 AS f", "id").write.parquet(f"{tmpdir_fresh}/rows")
    rows_ = spark.read.parquet(f"{tmpdir_fresh}/rows")
    lines = tx._lines(rows_, "concat('f', f)", {0: [("A", "id")], 1: [("B", "id")]}, "CAST(f % 2 AS INT)", None)

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    assert scans(lines.where("_order < 2 AND _file IS NOT NULL")) == 1 and scans(lines.where("_order = 2")) == 2
    assert rows(lines.where("_order < 2"), "_file", "_order", "line") == [("f0", 1, "A"), ("f1", 1, "B"), ("f2", 1, "A"), ("f3", 1, "B")]
