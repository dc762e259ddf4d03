"""One store holding a third of all rows: results equal a brute-force
computation, and the plan spreads the hot store (order-level shuffle keyed
by order id; money partially aggregated before its shuffle)."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd

from periodlens import ReportParams
from periodlens.operators import compare

P = ReportParams.of(pre=(dt.date(2025, 11, 1), dt.date(2025, 11, 30)),
                    post=(dt.date(2025, 12, 1), dt.date(2025, 12, 31)))
SCHEMA = ("platform string, store_id string, order_id string, event_date date, "
          "sales decimal(18,4), payouts decimal(18,4)")


def skewed_rows(n=3000, seed=11):
    rnd = random.Random(seed)
    days = [dt.date(2024, 11, 1) + dt.timedelta(days=i) for i in range(430)]
    rows = []
    for i in range(n):
        store = "HOT" if i % 3 == 0 else f"s{rnd.randrange(60)}"
        rows.append((rnd.choice(["DD", "UE"]), store, f"o{rnd.randrange(n // 2)}", rnd.choice(days),
                     Decimal(rnd.randrange(0, 10000)) / 100, Decimal(rnd.randrange(0, 8000)) / 100))
    return rows


def brute_force(rows):
    df = pd.DataFrame(rows, columns=["platform", "store_id", "order_id", "event_date", "sales", "payouts"])
    out = {}
    for p, (s, e) in P.windows.items():
        w = df[(df.event_date >= s) & (df.event_date <= e)]
        for (plat, store), g in w.groupby(["platform", "store_id"]):
            out.setdefault((plat, store), {})[p] = (sum(g.sales), g.order_id.nunique())
    return out


def test_hot_store_results(spark):
    rows = skewed_rows()
    got = {(r.platform, r.store_id, r.metric): r for r in
           compare.store_compare(spark.createDataFrame(rows, SCHEMA), P).collect()}
    want = brute_force(rows)
    assert {(k[0], k[1]) for k in got} == set(want)
    for (plat, store), per in want.items():
        for p, (sales, orders) in per.items():
            assert getattr(got[(plat, store, "sales")], p) == float(round(sales, 1))
            assert getattr(got[(plat, store, "orders")], p) == float(orders)


def test_hot_store_plan(spark):
    df = compare.store_compare(spark.createDataFrame(skewed_rows(300), SCHEMA), P)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    exchanges = [ln for ln in plan.splitlines() if "hashpartitioning(" in ln]
    assert any("order_id" in ln for ln in exchanges)          # hot store spread over its orders
    assert "partial_sum" in plan and "partial_bit_or" in plan  # map-side pre-aggregation
    assert "Expand" not in plan
