"""Pinned report semantics on small invented facts (gotchas G1-G22, M*, P*, J*)."""

import datetime as dt
from decimal import Decimal

import pytest

from periodlens import ReportParams, last_year
from periodlens.functions.slots import DD_AS_CODED, STANDARD, slot_sql
from periodlens.operators import compare, daily, facts, insights, slots, summary

D = dt.date
P = ReportParams.of(pre=(D(2025, 11, 1), D(2025, 11, 30)), post=(D(2025, 12, 1), D(2025, 12, 31)))
FACT_SCHEMA = ("platform string, store_id string, order_id string, event_date date, "
               "minute_of_day int, sales decimal(18,4), payouts decimal(18,4)")


def fact(spark, rows):
    return spark.createDataFrame(
        [(p, s, o, d, m, Decimal(str(a)), Decimal(str(b))) for p, s, o, d, m, a, b in rows], FACT_SCHEMA)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_last_year_feb_29():
    assert last_year(D(2024, 2, 29)) == D(2023, 2, 28)
    p = ReportParams.of(pre=(D(2024, 2, 29), D(2024, 3, 1)), post=(D(2024, 3, 2), D(2024, 3, 3)))
    assert p.windows["pre_24"] == (D(2023, 2, 28), D(2023, 3, 1))


def test_last_year_matches_spark_add_months(spark):
    days = [D(2024, 2, 29), D(2024, 3, 31), D(2025, 1, 31), D(2025, 12, 31)]
    got = spark.createDataFrame([(d,) for d in days], "d date").selectExpr("add_months(d, -12) AS x")
    assert [r.x for r in got.collect()] == [last_year(d) for d in days]


def test_overlapping_windows_count_row_in_both(spark):
    p = ReportParams.of(pre=(D(2025, 11, 1), D(2025, 11, 20)), post=(D(2025, 11, 10), D(2025, 11, 30)))
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 15), 0, 10, 8)])
    r = by_key(compare.store_compare(f, p), "metric")
    assert r[("sales",)].pre_25 == 10.0 and r[("sales",)].post_25 == 10.0
    assert r[("orders",)].pre_25 == 1.0 and r[("orders",)].post_25 == 1.0
    tagged = facts.tag_periods(f, p).select("period").collect()
    assert sorted(x.period for x in tagged) == ["post_25", "pre_25"]


def test_distinct_orders_per_window(spark):
    f = fact(spark, [
        ("DD", "1", "a", D(2025, 11, 2), 0, 1, 1), ("DD", "1", "a", D(2025, 11, 3), 0, 1, 1),
        ("DD", "1", "a", D(2025, 12, 3), 0, 1, 1), ("DD", "1", None, D(2025, 12, 3), 0, 5, 5),
    ])
    r = by_key(compare.store_compare(f, P), "metric")
    assert (r[("orders",)].pre_25, r[("orders",)].post_25) == (1.0, 1.0)
    assert r[("sales",)].post_25 == 6.0      # null order id still counts for money


def test_excluded_days_removed_everywhere(spark):
    p = ReportParams.of(pre=(D(2025, 11, 1), D(2025, 11, 30)), post=(D(2025, 12, 1), D(2025, 12, 31)),
                        excluded=[D(2025, 12, 25), D(2024, 11, 28)])
    f = fact(spark, [("DD", "1", "a", D(2025, 12, 25), 0, 100, 1), ("DD", "1", "b", D(2025, 12, 24), 0, 1, 1),
                     ("DD", "1", "c", D(2024, 11, 28), 0, 7, 1)])
    r = by_key(compare.store_compare(f, p), "metric")
    assert r[("sales",)].post_25 == 1.0 and r[("sales",)].pre_24 == 0.0
    days = spark.createDataFrame([(D(2025, 12, 25),), (D(2024, 11, 28),)], "d date")
    r2 = by_key(compare.store_compare(facts.exclude_days(f, days), P), "metric")
    assert r2[("sales",)].post_25 == 1.0
    cells = daily.daily_cells_dec(f, p).collect()
    assert all(c.event_date not in (D(2025, 12, 25), D(2024, 11, 28)) for c in cells)


def test_zero_denominator_rules(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 12, 2), 0, 50, 40)])
    cmp_dec = compare.store_compare_dec(f, P)
    store = by_key(compare.store_compare(f, P), "metric")[("sales",)]
    assert store.growth_pct == 5000.0                       # store level: divide by 1 (M2)
    summ = by_key(summary.platform_summary(cmp_dec), "metric")
    assert summ[("Sales",)].growth_pct == 0.0               # summary level: 0 (M3)
    t1 = compare.store_table_pre_post_dec(cmp_dec)
    comb = by_key(compare.combined_store_pre_post(t1), "store_id")
    assert comb[("1",)].growth_pct == 0.0                   # combined store level: 0 (M4)


def test_half_even_rounding_and_sum_of_rounded(spark):
    # 0.25 + 0.25 -> each store rounds to 0.2, the summary adds rounded values -> 0.4
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), 0, "0.25", 0), ("DD", "2", "b", D(2025, 11, 2), 0, "0.25", 0),
                     ("DD", "3", "c", D(2025, 11, 2), 0, "0.35", 0)])
    cmp_dec = compare.store_compare_dec(f, P)
    stores = by_key(compare.store_compare(f, P).where("metric = 'sales'"), "store_id")
    assert stores[("1",)].pre_25 == 0.2 and stores[("3",)].pre_25 == 0.4
    summ = by_key(summary.platform_summary(cmp_dec), "metric")
    assert summ[("Sales",)].pre == 0.8


def test_profitability_and_average_check_from_rounded_totals(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), 0, 100, 30), ("DD", "1", "b", D(2025, 12, 2), 0, 200, 50),
                     ("DD", "1", "c", D(2025, 12, 3), 0, 100, 25)])
    s = by_key(summary.platform_summary(compare.store_compare_dec(f, P)), "metric")
    assert (s[("Profitability",)].pre, s[("Profitability",)].post) == (30.0, 25.0)
    assert s[("Profitability",)].growth_pct == round((25 - 30) / 30 * 100, 1)
    assert (s[("Average Check",)].pre, s[("Average Check",)].post) == (100.0, 150.0)


def test_store_table_drops_empty_rows(spark):
    f = fact(spark, [("DD", "1", "a", D(2024, 11, 2), 0, 9, 9), ("DD", "2", "b", D(2025, 11, 2), 0, "0.04", 0)])
    t1 = compare.store_table_pre_post(compare.store_compare_dec(f, P)).collect()
    assert t1 == []        # store 1: pre = post = 0; store 2 rounds to 0.0 (F5)


def test_combined_store_sums_platforms(spark):
    f = fact(spark, [("DD", "7", "a", D(2025, 11, 2), 0, 10, 1), ("UE", "7", "b", D(2025, 12, 2), 0, 30, 1),
                     ("UE", "8", "c", D(2025, 12, 2), 0, 5, 1)])
    t1 = compare.store_table_pre_post_dec(compare.store_compare_dec(f, P))
    comb = by_key(compare.combined_store_pre_post(t1), "store_id")
    assert (comb[("7",)].pre, comb[("7",)].post, comb[("7",)].growth_pct) == (10.0, 30.0, 200.0)
    assert comb[("8",)].growth_pct == 0.0


@pytest.mark.parametrize("hhmm,dd,std", [
    ("10:58", "Breakfast", "Breakfast"), ("10:59", "Lunch", "Breakfast"), ("11:00", "Lunch", "Lunch"),
    ("13:59", "Afternoon", "Lunch"), ("15:59", "Dinner", "Afternoon"), ("16:59", "Dinner", "Afternoon"),
    ("17:00", "Dinner", "Dinner"), ("19:19", "Late night", "Dinner"), ("20:00", "Late night", "Late night"),
    ("00:00", "Overnight", "Overnight"), ("04:59", "Overnight", "Overnight"),
])
def test_slot_bounds(spark, hhmm, dd, std):
    h, m = map(int, hhmm.split(":"))
    r = spark.range(1).selectExpr(f"{slot_sql(str(h * 60 + m), DD_AS_CODED)} AS dd",
                                  f"{slot_sql(str(h * 60 + m), STANDARD)} AS std").collect()[0]
    assert (r.dd, r.std) == (dd, std)


def test_slot_tables_have_six_rows_and_post_without_pre(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 12, 2), 12 * 60, 10, 8)])   # no pre rows at all (G5)
    t = slots.slot_totals(f, P)
    pp = by_key(slots.slot_pre_post(t, "sales"), "platform", "slot")
    assert len(pp) == 12
    assert pp[("DD", "Lunch")].post == 10.0 and pp[("DD", "Lunch")].growth_pct == 0.0


def test_daily_cube_totals_add_cells(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 12, 2), 0, 1, 1), ("DD", "2", "a", D(2025, 12, 2), 0, 2, 1),
                     ("DD", "1", "b", D(2025, 12, 3), 0, 4, 1)])
    cube = daily.daily_cube(daily.daily_cells_dec(f, P)).where("period = 'post_25'")
    rows = by_key(cube, "event_date", "store_id")
    assert rows[(D(2025, 12, 2), None)].sales == 3.0
    assert rows[(None, "1")].sales == 5.0 and rows[(None, None)].sales == 7.0
    assert rows[(D(2025, 12, 2), None)].orders == 2     # sum of per-store distinct counts


def test_daily_wide_lists_stores_and_the_rest(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 12, 2), 0, 1, 1), ("DD", "2", "b", D(2025, 12, 3), 0, 2, 1)]
             + [("DD", str(i), f"c{i}", D(2025, 12, 3), 0, 1, 1) for i in range(10, 1500)])
    w = daily.daily_wide(daily.daily_cells_dec(f, P, periods=("post_25",)), ["1", "2", "absent"])
    assert w.columns == ["platform", "period", "metric", "event_date", "1", "2", "absent", "Other", "Total"]
    got = by_key(w.where("metric = 'sales'"), "event_date")
    assert got[(D(2025, 12, 2),)]["2"] == 0.0 and got[(D(2025, 12, 2),)]["Total"] == 1.0
    assert got[(D(2025, 12, 3),)]["Other"] == 1490.0 and got[(None,)]["absent"] == 0.0
    assert got[(None,)]["Total"] == 1493.0 and w.count() == 9


def test_rows_without_a_store_are_dropped_whatever_the_metrics(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), 0, 1, 1), ("DD", None, "b", D(2025, 11, 2), 0, 2, 1)])
    for metrics in (["sales"], ["orders"], list(compare.METRICS)):
        assert {r.store_id for r in compare.store_compare(f, P, metrics).collect()} == {"1"}


def test_one_selection_per_platform(spark):
    f = fact(spark, [(p, s, f"{p}{s}", D(2025, 11, 2), 0, v, 1) for p, s, v in
                     [("DD", "1", 1), ("DD", "2", 2), ("UE", "1", 4), ("UE", "2", 8)]])
    c = compare.store_compare_dec(f, P)
    frame = spark.createDataFrame([("DD", "1"), ("UE", "2"), ("UE", "9")], "platform string, store_id string")
    for sel, dd, ue in [({"DD": ["1"], "UE": ["2"]}, 1, 8), ({"DD": ["1"]}, 1, 12), ({"DD": None, "UE": ["1"]}, 3, 4), (["2"], 2, 8), (frame, 1, 8), ({"UE": []}, 3, 0)]:
        got = {(r.platform, r.metric): r.pre for r in summary.platform_summary(c, sel).collect()}
        assert (got.get(("DD", "Sales"), 0), got.get(("UE", "Sales"), 0)) == (dd, ue), sel
    # counts and directory come from the selection, not from the stores with data
    sel = {"DD": ["1", "7"], "UE": ["9"]}
    counts = by_key(summary.store_counts(c, sel), "platform")
    assert [(counts[(p,)].selected_stores, counts[(p,)].total_stores) for p in ("DD", "UE")] == [(2, 2), (1, 2)]
    assert [(r.store_id, r.first_platform) for r in insights.store_directory(c, sel).collect()] == [("1", "DD"), ("7", "DD"), ("9", "UE")]
    odd = ["it's", "back\\slash"]
    f2 = fact(spark, [("DD", s, s, D(2025, 11, 2), 0, 1, 1) for s in odd])
    assert facts.select_stores(f2, odd).count() == 2


def test_store_selection_list_and_frame(spark):
    f = fact(spark, [("DD", "1", "a", D(2025, 11, 2), 0, 1, 1), ("DD", "2", "b", D(2025, 11, 2), 0, 2, 1)])
    c = compare.store_compare_dec(f, P)
    assert by_key(summary.platform_summary(c, ["2"]), "metric")[("Sales",)].pre == 2.0
    sel = spark.createDataFrame([("1",)], "s string")
    assert by_key(summary.platform_summary(c, sel), "metric")[("Sales",)].pre == 1.0
    assert by_key(summary.store_counts(c, ["2"]), "platform")[("DD",)].selected_stores == 1


def test_top_bottom_and_movers(spark):
    rows = [("DD", str(i), f"o{i}", D(2025, 11, 2), 0, 10, 1) for i in range(6)]
    rows += [("DD", str(i), f"p{i}", D(2025, 12, 2), 0, 10 + i, 1) for i in range(6)]
    f = fact(spark, rows)
    bw = insights.best_worst_stores(compare.store_compare(f, P)).collect()
    worst = sorted((r.rank, r.store_id) for r in bw if r.kind == "worst")
    best = sorted((r.rank, r.store_id) for r in bw if r.kind == "best")
    assert worst == [(1, "0"), (2, "1"), (3, "2")] and best == [(1, "5"), (2, "4"), (3, "3")]
    t1 = compare.store_table_pre_post_dec(compare.store_compare_dec(f, P))
    mv = insights.store_movers([("Combined", compare.combined_store_pre_post(t1))], k=2).collect()
    assert [r.store_id for r in mv] == ["5", "4"] and mv[0].direction == "Gain"
