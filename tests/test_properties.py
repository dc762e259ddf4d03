"""Invariants on generated facts (hypothesis): combined = DD + UE, cube total =
sum of cells, excluded days are additive, input order does not matter."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodlens import ReportParams
from periodlens.operators import compare, daily, summary

P = ReportParams.of(pre=(dt.date(2025, 11, 1), dt.date(2025, 11, 30)),
                    post=(dt.date(2025, 12, 1), dt.date(2025, 12, 31)))
DAYS = [dt.date(2024, 11, 1) + dt.timedelta(days=i) for i in range(0, 430, 7)]
SCHEMA = ("platform string, store_id string, order_id string, event_date date, "
          "minute_of_day int, sales decimal(18,4), payouts decimal(18,4)")

row = st.tuples(st.sampled_from(["DD", "UE"]), st.sampled_from(["1", "2", "3"]),
                st.sampled_from(["a", "b", "c", "d", None]), st.sampled_from(DAYS),
                st.integers(0, 1439), st.integers(-500, 5000), st.integers(0, 4000))
facts = st.lists(row, min_size=1, max_size=25)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def make(spark, rows):
    return spark.createDataFrame(
        [(p, s, o, d, m, Decimal(a) / 100, Decimal(b) / 100) for p, s, o, d, m, a, b in rows], SCHEMA)


@SETTINGS
@given(facts)
def test_combined_equals_sum_of_platforms(spark, rows):
    c = compare.store_compare_dec(make(spark, rows), P)
    plat = {(r.platform, r.metric): r for r in summary.platform_summary(c).collect()}
    comb = {r.metric: r for r in summary.combined_summary(c).collect()}
    for m in ("Sales", "Payouts", "Orders"):
        for col in ("pre", "post", "prevs_post", "last_year_post", "yoy"):
            parts = [getattr(plat[(p, m)], col) for p in ("DD", "UE") if (p, m) in plat]
            assert abs(getattr(comb[m], col) - sum(parts)) < 1e-6


@SETTINGS
@given(facts)
def test_cube_corner_is_sum_of_cells(spark, rows):
    cells = daily.daily_cells_dec(make(spark, rows), P)
    cube = daily.daily_cube(cells)
    corners = {(r.platform, r.period): r.sales for r in
               cube.where("is_total_row = 1 AND is_total_col = 1").collect()}
    sums = {(r.platform, r.period): float(r.s) for r in
            cells.groupBy("platform", "period").agg(F.sum("sales").alias("s")).collect()}
    assert corners == sums


@SETTINGS
@given(facts, st.sampled_from(DAYS))
def test_excluding_a_day_removes_exactly_its_rows(spark, rows, day):
    f = make(spark, rows)
    px = ReportParams.of(pre=(P.pre_start, P.pre_end), post=(P.post_start, P.post_end), excluded=[day])
    full = {(r.platform, r.store_id): r.post_25 for r in
            compare.store_compare(f, P, ["sales"]).collect()}
    cut = {(r.platform, r.store_id): r.post_25 for r in
           compare.store_compare(f, px, ["sales"]).collect()}
    only = {(r.platform, r.store_id): r.post_25 for r in
            compare.store_compare(f.where(F.col("event_date") == day), P, ["sales"]).collect()}
    for k, v in full.items():
        assert abs(v - cut.get(k, 0.0) - only.get(k, 0.0)) < 0.2   # values are rounded to 0.1


@SETTINGS
@given(facts)
def test_input_order_does_not_matter(spark, rows):
    f = make(spark, rows)
    a = sorted(map(tuple, compare.store_compare(f, P).collect()))
    b = sorted(map(tuple, compare.store_compare(f.repartition(5).orderBy(F.rand(7)), P).collect()))
    assert a == b
