"""Store-level period comparison (R1, R2, R6; A1-A3, J1, M1, M2, M4, M8).

One pass over the fact computes every window total for every store:

1. rows outside all windows or on excluded days are dropped (pushed filters);
2. money: ``groupBy(platform, store_id)`` with one conditional sum per
   window; map-side partial aggregation collapses every task to one row per
   store before the shuffle, so a store holding a third of all rows costs
   nothing extra;
3. orders: ``groupBy(platform, store_id, order_id)`` keeps one row per order
   with a bit mask of the windows it falls in (a hot store is spread over
   its many orders), then ``groupBy(platform, store_id)`` counts each bit;
4. the two per-store results are joined on the store key (both sides are
   already partitioned by it).

This replaces four full outer joins per metric and avoids the ``Expand``
that several ``count(DISTINCT ...)`` aggregates in one group-by would add;
the order-level shuffle carries keys and one integer, not the money sums.
Money stays DECIMAL until the very end so totals are exact; values are
rounded half-to-even at one decimal, as the reports show them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM
from ..params import PERIODS, ReportParams, window_flags_sql
from .facts import report_rows, select_stores

# Metric keys and their display names.
METRICS = ("sales", "payouts", "orders")
METRIC_NAMES = {"sales": "Sales", "payouts": "Payouts", "orders": "Orders",
                "new_customers": "New Customers", "profitability": "Profitability",
                "average_check": "Average Check"}
# The columns of the comparison table.
DELTAS = ("prevs_post", "last_year_pre_vs_post", "yoy")
PCTS = ("growth_pct", "yoy_pct")
COMPARE_COLS = PERIODS + DELTAS + PCTS
TABLE1_COLS = ("pre", "post", "prevs_post", "last_year_pre_vs_post", "growth_pct")
TABLE2_COLS = ("last_year_post", "post", "yoy", "yoy_pct")


def as_double(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    cols = set(cols)
    return df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" if c in cols else f"`{c}`"
                           for c in df.columns])


def window_totals(fact: DataFrame, params: ReportParams, keys: Sequence[str] = ("platform", "store_id"),
                  measures: Sequence[str] = ("sales", "payouts"), count_orders: bool = True,
                  periods: Sequence[str] = PERIODS, rows_filtered: bool = False,
                  date_col: str = "event_date", approx_orders: bool = False) -> DataFrame:
    """Per-key window totals: ``<measure>__<period>`` DECIMAL(28,4) and
    ``orders__<period>`` (distinct non-null ``order_id``) BIGINT.

    ``keys`` must be non-empty when orders are counted.

    ``approx_orders`` counts orders with HyperLogLog++ sketches instead
    (one shuffle instead of two, fixed memory per group, ~2% error)."""
    rows = fact if rows_filtered else report_rows(fact, params, periods, date_col)
    flags = window_flags_sql(params, date_col, periods)
    keys = list(keys)
    for k in keys:  # groups without a key are dropped once, before both aggregates (G22)
        rows = rows.where(F.col(k).isNotNull())
    if approx_orders and count_orders:
        return rows.groupBy(*keys).agg(
            *[F.expr(f"CAST(coalesce(sum(CASE WHEN {c} THEN `{m}` END), 0) AS {MONEY_SUM}) AS `{m}__{p}`")
              for p, c in flags.items() for m in measures],
            *[F.expr(f"approx_count_distinct(CASE WHEN {c} THEN order_id END) AS `orders__{p}`")
              for p, c in flags.items()])
    sums = [F.expr(f"CAST(coalesce(sum(CASE WHEN {c} THEN `{m}` END), 0) AS {MONEY_SUM}) AS `{m}__{p}`")
            for p, c in flags.items() for m in measures]
    if not count_orders:
        return rows.groupBy(*keys).agg(*sums)
    # Orders: one row per (key, order) carrying only a bit mask of the windows
    # the order appears in, then a count per window bit.  The wide money sums
    # never ride on this (largest) shuffle.
    bits = " | ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(flags.values()))
    per_order = rows.groupBy(*keys, "order_id").agg(F.expr(f"bit_or({bits}) AS _mask"))
    orders = per_order.groupBy(*keys).agg(*[
        F.expr(f"count(CASE WHEN order_id IS NOT NULL AND (_mask & {1 << i}) <> 0 THEN 1 END)"
               f" AS `orders__{p}`") for i, p in enumerate(flags)])
    if not measures:
        return orders
    # Money: summed straight per key; map-side partial aggregation leaves one
    # row per key and task, so this shuffle is tiny whatever the skew.
    money = rows.groupBy(*keys).agg(*sums)
    # Both sides hold exactly the (non-null) keys that have rows and are already
    # partitioned by them, so the join adds no exchange.
    return money.join(orders, keys, "inner")


def metric_rows(totals: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Wide window totals -> one row per (keys, metric) with the four windows
    (metrics to rows, D5)."""
    structs = ", ".join(
        "named_struct('metric', '" + m + "', "
        + ", ".join(f"'{p}', CAST(`{m}__{p}` AS {MONEY_SUM})" for p in PERIODS) + ")"
        for m in metrics)
    return totals.select(*keys, F.expr(f"inline(array({structs}))"))


# Zero-denominator rules as SQL text (see functions.numeric).
def pct_den_one_sql(delta: str, den: str) -> str:
    """Store level (M2): a zero denominator is replaced by 1."""
    return (f"CAST({delta} AS DOUBLE) / CAST(CASE WHEN {den} = 0 THEN 1 ELSE {den} END AS DOUBLE)"
            f" * 100.0D")


def pct_or_zero_sql(delta: str, den: str) -> str:
    """Summary level (M3, M4): zero when the denominator is zero."""
    return (f"CASE WHEN {den} = 0 THEN 0.0D ELSE CAST({delta} AS DOUBLE) / CAST({den} AS DOUBLE)"
            f" * 100.0D END")


def compare_exprs() -> list[Column]:
    """Derived comparison columns from unrounded window values (M1, M2, M8)."""
    deltas = {"prevs_post": "(post_25 - pre_25)", "last_year_pre_vs_post": "(post_24 - pre_24)",
              "yoy": "(post_25 - post_24)"}
    out = [f"bround({p}, 1) AS {p}" for p in PERIODS]
    out += [f"bround({v}, 1) AS {k}" for k, v in deltas.items()]
    out += [f"bround({pct_den_one_sql(deltas['prevs_post'], 'pre_25')}, 1) AS growth_pct",
            f"bround({pct_den_one_sql(deltas['yoy'], 'post_24')}, 1) AS yoy_pct"]
    return [F.expr(e) for e in out]


def store_compare_dec(fact: DataFrame, params: ReportParams,
                      metrics: Sequence[str] = METRICS, approx_orders: bool = False) -> DataFrame:
    """R1 with DECIMAL values: platform, store_id, metric, windows, deltas, pcts.

    A store is listed when it has at least one row in any window.
    """
    money = [m for m in metrics if m != "orders"]
    totals = window_totals(fact, params, measures=money,
                           count_orders="orders" in metrics, approx_orders=approx_orders)
    long = metric_rows(totals, metrics, ["platform", "store_id"])
    return long.select("platform", "store_id", "metric", *compare_exprs())


def store_compare(fact: DataFrame, params: ReportParams,
                  metrics: Sequence[str] = METRICS, approx_orders: bool = False) -> DataFrame:
    """Per platform, store and metric, the four windows and their changes."""
    return as_double(store_compare_dec(fact, params, metrics, approx_orders), COMPARE_COLS)


def _nonempty_store(c: str = "store_id") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def store_table_pre_post_dec(compare: DataFrame, stores=None, metric: str = "sales") -> DataFrame:
    """R2 table 1 (Pre, Post, PrevsPost, LastYear Pre vs Post, Growth%), F5 applied."""
    df = select_stores(compare.where(F.col("metric") == metric), stores)
    return (df.select("platform", "store_id",
                      F.col("pre_25").alias("pre"), F.col("post_25").alias("post"),
                      "prevs_post", "last_year_pre_vs_post", "growth_pct")
              .where(_nonempty_store() & ((F.col("pre") != 0) | (F.col("post") != 0))))


def store_table_yoy_dec(compare: DataFrame, stores=None, metric: str = "sales") -> DataFrame:
    """R2 table 2 (last year-post, post, YoY, YoY%), F5 applied."""
    df = select_stores(compare.where(F.col("metric") == metric), stores)
    return (df.select("platform", "store_id",
                      F.col("post_24").alias("last_year_post"), F.col("post_25").alias("post"),
                      "yoy", "yoy_pct")
              .where(_nonempty_store() & ((F.col("last_year_post") != 0) | (F.col("post") != 0))))


def store_table_pre_post(compare_dec: DataFrame, stores=None, metric: str = "sales") -> DataFrame:
    return as_double(store_table_pre_post_dec(compare_dec, stores, metric), TABLE1_COLS)


def store_table_yoy(compare_dec: DataFrame, stores=None, metric: str = "sales") -> DataFrame:
    return as_double(store_table_yoy_dec(compare_dec, stores, metric), TABLE2_COLS)


def combined_store_pre_post(table1_dec: DataFrame) -> DataFrame:
    """R6 table 1: per-platform table 1 rows summed by store; Growth% recomputed
    from the summed rounded values, zero when Pre is zero (J3, M4)."""
    s = table1_dec.groupBy("store_id").agg(
        *[F.sum(c).alias(c) for c in ("pre", "post", "prevs_post", "last_year_pre_vs_post")])
    out = s.select("store_id", "pre", "post", "prevs_post", "last_year_pre_vs_post",
                   F.expr(f"bround({pct_or_zero_sql('prevs_post', 'pre')}, 1) AS growth_pct"))
    out = out.where(_nonempty_store() & ((F.col("pre") != 0) | (F.col("post") != 0)))
    return as_double(out, TABLE1_COLS)


def combined_store_yoy(table2_dec: DataFrame) -> DataFrame:
    """R6 table 2: per-platform table 2 rows summed by store, YoY% recomputed."""
    s = table2_dec.groupBy("store_id").agg(
        *[F.sum(c).alias(c) for c in ("last_year_post", "post", "yoy")])
    out = s.select("store_id", "last_year_post", "post", "yoy",
                   F.expr(f"bround({pct_or_zero_sql('yoy', 'last_year_post')}, 1) AS yoy_pct"))
    out = out.where(_nonempty_store() & ((F.col("last_year_post") != 0) | (F.col("post") != 0)))
    return as_double(out, TABLE2_COLS)
