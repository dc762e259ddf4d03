"""Store pages, order sets, windows and ranges as data, whole runs (brute force and failure tests)."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from periodlens import ReportParams
from periodlens.operators import daily, ordersets, pages, ranges
from periodlens.sources import files, sinks
from periodlens.staging import Staging, numbered

D0 = dt.date(2025, 1, 1)
P = ReportParams.of(pre=("1/1/2025", "1/31/2025"), post=("2/1/2025", "2/28/2025"), excluded=["1/5/2025"])
FACT = "platform string, store_id string, order_id string, event_date date, sales decimal(18,4), payouts decimal(18,4)"


def facts(n=900, seed=1):
    """One store holds a third of all rows; some stores, orders and dates are missing."""
    from decimal import Decimal
    rng = random.Random(seed)
    out = []
    for i in range(n):
        store = rng.choice([None, "hot", "hot", "hot", *[f"s{j}" for j in range(40)]]) if i % 3 else "hot"
        day = None if i % 97 == 0 else D0 + dt.timedelta(days=rng.randrange(70))
        out.append((rng.choice(["DD", "UE"]), store, rng.choice([None, f"o{rng.randrange(300)}"]), day, Decimal(rng.randrange(1000)) / 4, Decimal(1)))
    return out


@pytest.mark.parametrize("within", [[], ["g"]])
def test_numbered(spark, within):
    rows = [(i % 3 if i % 10 else None, i * 7 % 200, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, k int, x int").repartition(9)
    got = {(r.g, r.k): r["rank"] for r in numbered(Staging(spark), df, ["k"], within).collect()}
    groups = {}
    for g, k, _ in rows:
        groups.setdefault(g if within else 0, []).append((k, g))
    want = {(g, k): i for members in groups.values() for i, (k, g) in enumerate(sorted(members, key=lambda t: t[0]))}
    assert got == want


def test_pages_hold_every_store(spark):
    staging = Staging(spark)
    cells = staging.put(daily.daily_cells_dec(spark.createDataFrame(facts(), FACT), P))
    header = pages.page_header(staging, cells, 4)
    by = {(r.page, r.place): r.store_id for r in header.collect()}
    stores = sorted({r.store_id for r in cells.select("store_id").distinct().collect()})
    assert [by[k] for k in sorted(by)] == stores and max(p for _, p in by) == 3
    want = {}
    for r in cells.collect():
        for m in ("sales", "payouts", "orders"):
            for day in (r.event_date, None):
                want[r.platform, r.period, m, r.store_id, day] = want.get((r.platform, r.period, m, r.store_id, day), 0) + float(r[m])
    out = pages.store_pages(cells, header, 4).collect()
    got = {}
    for r in out:
        assert abs(sum(r[f"s{i:02d}"] for i in range(4)) - r.page_total) < 1e-6
        for i in range(4):
            if r[f"s{i:02d}"]:
                got[r.platform, r.period, r.metric, by[r.page, i], r.event_date] = r[f"s{i:02d}"]
    assert got == {k: v for k, v in want.items() if v}
    sums = {}
    for r in out:
        sums.setdefault((r.platform, r.period, r.metric, r.event_date), [0, r.total])[0] += r.page_total
    assert all(abs(a - b) < 1e-6 for a, b in sums.values())


def test_wide_totals_add_up_with_null_stores_and_reserved_names(spark):
    from decimal import Decimal
    rows = [("DD", s, "o", D0, Decimal(5), Decimal(1)) for s in (None, "Total", "Other", "metric", "7", "8")]
    cells = daily.daily_cells_dec(spark.createDataFrame(rows, FACT), P)
    wide = daily.daily_wide(cells, ["Total", "7", "metric"]).where("metric = 'sales' AND event_date IS NOT NULL").first().asDict()
    assert (wide["store Total"], wide["store metric"], wide["7"], wide["Other"], wide["Total"]) == (5.0, 5.0, 5.0, 10.0, 25.0)


def brute_orders(rows):
    out = {}
    for platform, store, order, day, *_ in rows:
        if store is None or day is None or day in P.excluded:
            continue
        for p, (lo, hi) in P.windows.items():
            if lo <= day <= hi:
                out.setdefault((platform, store), {}).setdefault(p, set())
                if order is not None:
                    out[platform, store][p].add(order)
    return {k: {p: len(s) for p, s in v.items() if s} for k, v in out.items() if any(v.values())}


def test_order_sets_are_exact_and_mergeable(spark):
    """The union of the states of two drops equals the state of both; numbers stay."""
    a, b = facts(600, 2), facts(600, 3)
    staging = Staging(spark)
    fa, fb = (spark.createDataFrame(x, FACT) for x in (a, b))
    na = ordersets.number_orders(staging, fa)
    nb = ordersets.number_orders(staging, fb, na)
    assert na.join(nb, ["platform", "store_id", "order_id", "number"], "left_anti").count() == 0
    per = nb.groupBy("platform", "store_id").agg(F.count("*").alias("n"), F.max("number").alias("m"), F.count_distinct("number").alias("u")).collect()
    assert all(r.n == r.m == r.u for r in per)
    sets = ordersets.united(ordersets.daily_sets(fa, na), ordersets.daily_sets(fb, nb))
    for got, rows in ((ordersets.daily_sets(fa, na), a), (sets, a + b)):
        found = {(r.platform, r.store_id): {p: r[p] for p in P.windows if r[p]} for r in ordersets.orders_in_windows(got, P).collect()}
        assert {k: v for k, v in found.items() if v} == brute_orders(rows)


def test_order_sets_beyond_one_bucket(spark):
    rows = spark.range(70_000).selectExpr("'DD' AS platform", "'s' AS store_id", "CAST(id AS STRING) AS order_id",
                                          "date_add(DATE'2025-01-06', CAST(id % 60 AS INT)) AS event_date")
    staging = Staging(spark)
    sets = ordersets.daily_sets(rows, ordersets.number_orders(staging, rows))
    r = ordersets.orders_in_windows(sets, P).first()
    days = [(dt.date(2025, 1, 6) + dt.timedelta(days=i % 60)) for i in range(60)]
    per_day = [70_000 // 60 + (i < 70_000 % 60) for i in range(60)]
    assert r.pre_25 == sum(n for d, n in zip(days, per_day) if d <= dt.date(2025, 1, 31))
    assert r.post_25 == sum(n for d, n in zip(days, per_day) if dt.date(2025, 2, 1) <= d <= dt.date(2025, 2, 28))


@pytest.mark.parametrize("bucket", [1, 7, 32, 400])
def test_windows_as_data(spark, bucket):
    rows, rng = facts(), random.Random(4)
    windows = [(i, None if i == 5 else D0 + dt.timedelta(days=rng.randrange(-5, 75)), D0 + dt.timedelta(days=rng.randrange(-5, 90))) for i in range(150)]
    days = ranges.day_totals(spark.createDataFrame(rows, FACT), ["platform", "store_id"])
    got = {(r.window_id, r.platform, r.store_id): (r["rows"], r.sales) for r in ranges.window_totals_batch(
        days, spark.createDataFrame(windows, "window_id int, start_date date, end_date date"), ["platform", "store_id"], bucket_days=bucket).collect()}
    want = {}
    for i, lo, hi in windows:
        for platform, store, _, day, sales, _ in rows:
            if lo is not None and store is not None and day is not None and lo <= day <= hi:
                n, s = want.get((i, platform, store), (0, 0))
                want[i, platform, store] = (n + 1, s + sales)
    assert got == want


def test_ranges_from_running_totals(spark):
    rows, rng = facts(), random.Random(6)
    asked = [(i, rng.choice(["DD", "UE"]), rng.choice(["hot", "hot", "s1", "s2", "none", None]), D0 + dt.timedelta(days=rng.randrange(-9, 80)),
              D0 + dt.timedelta(days=rng.randrange(-9, 80))) for i in range(300)]
    days = ranges.day_totals(spark.createDataFrame(rows, FACT), ["platform", "store_id"])
    out = ranges.range_totals(days, spark.createDataFrame(asked, "range_id int, platform string, store_id string, start_date date, end_date date")).collect()
    assert len(out) == 300
    for r in out:
        own = [x[4] for x in rows if x[1] is not None and (x[0], x[1]) == (r.platform, r.store_id) and x[3] is not None and r.start_date <= x[3] <= r.end_date]
        assert (r["rows"], r.sales) == (len(own), sum(own))


# ------------------------------------------------------------------ whole runs

def tables(spark, bad=False):
    good = {"a": spark.createDataFrame([(1, "x"), (2, None)], "n int, t string"), "empty": spark.createDataFrame([], "n int"),
            "z": spark.createDataFrame([(dt.date(2025, 1, 1), 2.5)], "d date, v double")}
    if bad:
        good["m"] = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("n"))
    return dict(sorted(good.items()))


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_run_is_read_back(spark, tmpdir_fresh, fmt):
    sinks.write_run(spark, tables(spark), tmpdir_fresh, "r1", "alpha", fmt)
    got = sinks.read_run(spark, tmpdir_fresh, "r1")
    assert sorted((r.n, r.t, r.run_id, r.operator) for r in got["a"].collect()) == [(1, "x", "r1", "alpha"), (2, None, "r1", "alpha")]
    assert got["empty"].count() == 0 and got["z"].first().v == 2.5
    assert sinks.runs(spark, tmpdir_fresh) == ["r1"] and not os.listdir(os.path.join(tmpdir_fresh, "_runs"))
    assert spark.read.format(fmt).option("header", True).load(os.path.join(tmpdir_fresh, "a")).where("run_id = 'r1'").count() == 2


def test_failed_run_leaves_nothing(spark, tmpdir_fresh):
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(spark, tables(spark, bad=True), tmpdir_fresh, "r1")
    assert sinks.runs(spark, tmpdir_fresh) == [] and os.listdir(tmpdir_fresh) == ["_runs"] and not os.listdir(os.path.join(tmpdir_fresh, "_runs"))
    with pytest.raises(LookupError):
        sinks.read_run(spark, tmpdir_fresh, "r1")


@pytest.mark.parametrize("failing", [1, 2, 3, 4])
def test_run_that_dies_while_it_is_published_is_not_committed(spark, tmpdir_fresh, monkeypatch, failing):
    """Whichever rename is the last one, readers of manifests see the whole run or none, and a second try mends it."""
    real, calls = files.rename, []

    def rename(*args):
        calls.append(args)
        if len(calls) == failing:
            raise OSError("executor and driver lost")
        real(*args)

    monkeypatch.setattr(files, "rename", rename)
    last = len([t for t in tables(spark) if t != "empty"]) + 1
    if failing <= last:
        with pytest.raises(OSError):
            sinks.write_run(spark, tables(spark), tmpdir_fresh, "r1")
        assert sinks.runs(spark, tmpdir_fresh) == []
    monkeypatch.setattr(files, "rename", real)
    sinks.write_run(spark, tables(spark), tmpdir_fresh, "r1")
    assert sinks.read_run(spark, tmpdir_fresh, "r1")["a"].count() == 2


def test_missing_files_of_a_run_are_noticed(spark, tmpdir_fresh):
    sinks.write_run(spark, tables(spark), tmpdir_fresh, "r1")
    folder = os.path.join(tmpdir_fresh, "a", "run_id=r1", "operator=default")
    part = next(f for f in os.listdir(folder) if f.startswith("part-"))
    os.remove(os.path.join(folder, part))
    with pytest.raises(ValueError, match="table a"):
        sinks.read_run(spark, tmpdir_fresh, "r1")


def test_bitmaps_are_not_shuffled(spark):
    """The numbers of a store, day and bucket meet before their bitmap is made, and are not broadcast."""
    rows = spark.range(3000).selectExpr("IF(id < 1500, 'DD', 'UE') AS platform", "CAST(id % 7 AS STRING) AS store_id", "id % 900 AS order_id", "date_add(DATE'2025-01-01', CAST(id % 11 AS INT)) AS event_date")
    sets = ordersets.daily_sets(rows, ordersets.number_orders(Staging(spark), rows))
    p = sets._jdf.queryExecution().executedPlan().toString()
    whole, partial = p.index("bitmap_construct_agg"), p.index("partial_bitmap_construct_agg")
    assert "Exchange" not in p[whole:partial] and "BroadcastExchange" not in p
    want = rows.selectExpr("platform", "store_id", "event_date", "order_id").distinct().groupBy("platform", "store_id", "event_date").count().collect()
    got = sets.selectExpr("platform", "store_id", "event_date", "bitmap_count(orders) AS n").collect()
    assert {(r.platform, r.store_id, r.event_date): r.n for r in got} == {(r.platform, r.store_id, r.event_date): r["count"] for r in want}
