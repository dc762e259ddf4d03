"""SQL of the queries of ``more_catalog``."""

from __future__ import annotations

from . import more_catalog as mc
from .oracle import (_CELLS, _T1_DEC, _campaign_select, _wrap_round, ORACLE, ORDER_FACT, P, SLOT_FACT, T1, WIN, between, compare_ctes, compare_select,
                     dbl, long_cte, nc_cte, not_excluded, rows_cte, summary_rows, totals_by, totals_select, with_)

SQL: dict[str, str] = {}
W = mc.PAGE_WIDTH

_LONG = ("long AS (" + " UNION ALL ".join(
    f"SELECT platform, period, event_date, store_id, '{m}' AS metric, CAST({m} AS DECIMAL(28,4)) AS v FROM cells" for m in ("sales", "payouts", "orders")) + ")")
_RANKED = (f"ranked AS (SELECT store_id, CAST((row_number() OVER (ORDER BY store_id) - 1) // {W} AS INTEGER) AS page, "
           f"CAST((row_number() OVER (ORDER BY store_id) - 1) % {W} AS INTEGER) AS place FROM (SELECT DISTINCT store_id FROM cells WHERE store_id IS NOT NULL))")
_PLACES = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN place = {i} THEN v END), 0) AS DOUBLE) AS s{i:02d}" for i in range(W))
_PAGE = _PLACES + ", CAST(SUM(v) AS DOUBLE) AS page_total"
SQL["daily_store_pages"] = _CELLS.rstrip("\n") + f",\n{_LONG},\n{_RANKED},\n" + (
    "placed AS (SELECT * FROM long JOIN ranked USING (store_id)),\n"
    f"pages AS (SELECT platform, period, metric, page, event_date, {_PAGE} FROM placed GROUP BY GROUPING SETS "
    "((platform, period, metric, page, event_date), (platform, period, metric, page))),\n"
    "days AS (SELECT platform, period, metric, event_date, CAST(SUM(v) AS DOUBLE) AS total FROM long GROUP BY GROUPING SETS "
    "((platform, period, metric, event_date), (platform, period, metric)))\n"
    "SELECT pages.*, days.total FROM pages JOIN days ON pages.platform = days.platform AND pages.period = days.period AND pages.metric = days.metric "
    "AND pages.event_date IS NOT DISTINCT FROM days.event_date")
SQL["daily_store_page_header"] = _CELLS.rstrip("\n") + f",\n{_RANKED}\nSELECT page, place, store_id FROM ranked"

SQL["orders_from_daily_sets"] = with_(rows_cte()) + "SELECT platform, store_id, " + ", ".join(
    f"COUNT(DISTINCT CASE WHEN {between('event_date', P, p)} THEN order_id END) AS {p}" for p in WIN) + " FROM r GROUP BY platform, store_id"

_SUMS = f"COUNT(*) AS rows, {dbl('SUM(sales)')} AS sales, {dbl('SUM(payouts)')} AS payouts"
SQL["window_batch_totals"] = with_(
    f"f AS ({ORDER_FACT})",
    "days AS (SELECT platform, event_date, COUNT(*) AS n, SUM(sales) AS s, SUM(payouts) AS p FROM f GROUP BY platform, event_date)",
    "w AS (SELECT c_custkey AS window_id, DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS lo, "
    "DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 + c_custkey * 11 % 400 AS INTEGER) AS hi FROM customer)") + (
    f"SELECT window_id, platform, CAST(SUM(n) AS BIGINT) AS rows, {dbl('SUM(s)')} AS sales, {dbl('SUM(p)')} AS payouts "
    "FROM w JOIN days ON event_date BETWEEN lo AND hi GROUP BY window_id, platform")
SQL["range_totals"] = with_(
    f"f AS ({ORDER_FACT})", f"kept AS (SELECT * FROM f WHERE {not_excluded('event_date', P)})",
    "g AS (SELECT o_orderkey AS range_id, CASE WHEN o_orderstatus = 'F' THEN 'DD' ELSE 'UE' END AS platform, CAST(1 + o_custkey % 120 AS VARCHAR) AS store_id, "
    "CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 - 4 AS INTEGER) AS end_date FROM orders)") + (
    f"SELECT range_id, g.platform, g.store_id, start_date, end_date, COUNT(sales) AS rows, {dbl('COALESCE(SUM(sales), 0)')} AS sales, "
    f"{dbl('COALESCE(SUM(payouts), 0)')} AS payouts FROM g LEFT JOIN kept k ON k.platform = g.platform AND k.store_id = g.store_id "
    "AND k.event_date BETWEEN start_date AND end_date GROUP BY range_id, g.platform, g.store_id, start_date, end_date")


def _compare_all(params, metrics, fact=ORDER_FACT) -> str:
    parts = [f"t_{m} AS ({totals_select(params, m)})" for m in metrics]
    union = " UNION ALL ".join(f"SELECT * FROM t_{m}" for m in metrics)
    return with_(rows_cte(params, fact), *parts, f"t AS ({union})") + compare_select("t")


SQL["report_roundtrip"] = _compare_all(P, ("sales", "payouts", "orders"))
SQL["store_compare_zero_base"] = _compare_all(mc.SPARSE, ("sales", "orders"))
SQL["overlapping_windows"] = _compare_all(mc.OVERLAP, ("sales", "orders"))
_lo, _hi = {p: a for p, (a, _) in mc.MIDNIGHT.windows.items()}, {p: b for p, (_, b) in mc.MIDNIGHT.windows.items()}
_AT = {p: f"ts BETWEEN TIMESTAMP '{_lo[p]} 00:00:00' AND TIMESTAMP '{_hi[p]} 00:00:00'" for p in WIN}
_EVENTS = SLOT_FACT.replace("FROM events", ", ts FROM events")
SQL["end_at_midnight"] = with_(
    f"f AS ({_EVENTS})", "r AS (SELECT * FROM f WHERE " + " OR ".join(f"({c})" for c in _AT.values()) + ")",
    "t AS (" + " UNION ALL ".join(
        f"SELECT platform, store_id, '{m}' AS metric, " + ", ".join(f"COALESCE(SUM(CASE WHEN {c} THEN {m} END), 0) AS {p}" for p, c in _AT.items())
        + " FROM r GROUP BY platform, store_id" for m in ("sales",)) + ")") + compare_select("t")
SQL["platform_summary_zero_base"] = with_(
    compare_ctes(mc.BEFORE), nc_cte(mc.BEFORE), long_cte(False), totals_by("platform"), summary_rows("platform")) + (
    f"SELECT platform, metric, metric_order, {T1} FROM sm WHERE metric <> 'New Customers' OR platform = 'DD'")
_T1_COLS = f"{dbl('pre')} AS pre, {dbl('post')} AS post, {dbl('prevs_post')} AS prevs_post, {dbl('last_year_pre_vs_post')} AS last_year_pre_vs_post, growth_pct"
SQL["store_table_empty_rows"] = with_(compare_ctes(mc.SPARSE), _T1_DEC) + f"SELECT platform, store_id, {_T1_COLS} FROM t1"
SQL["campaign_zero_ratios"] = with_(
    "cf AS (SELECT 'promotion' AS channel, CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) || CASE WHEN l_linenumber > 3 THEN '-late' ELSE '' END AS campaign_key, "
    "CAST(l_shipdate AS DATE) AS event_date, CAST(CASE WHEN l_linenumber > 3 THEN 0 ELSE l_quantity END AS DECIMAL(18,4)) AS orders, "
    "CAST(l_extendedprice AS DECIMAL(18,4)) AS sales, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS spend "
    "FROM lineitem WHERE l_linestatus = 'F')",
    f"ca AS (SELECT channel, campaign_key, SUM(orders) AS orders, SUM(sales) AS sales, SUM(spend) AS spend FROM cf "
    f"WHERE {between('event_date', P, 'post_25')} AND {not_excluded('event_date', P)} GROUP BY channel, campaign_key)") + (
    _campaign_select("channel, campaign_key") + " FROM ca")


def _money(x: str, decimals: int = 1) -> str:
    r = f"round_even({x}, {decimals})"
    return f"CASE WHEN {r} < 0 THEN '-$' ELSE '$' END || format('{{:,.{decimals}f}}', abs({r}))"


def _pct(x: str) -> str:
    return f"printf('%.1f', round_even({x}, 1)) || '%'"


def _int(x: str) -> str:
    return f"format('{{:,.0f}}', round_even({x}, 0))"


def _by_metric(x: str) -> str:
    return f"CASE WHEN metric IN ('Orders', 'New Customers') THEN {_int(x)} WHEN metric = 'Profitability' THEN {_pct(x)} ELSE {_money(x)} END"


_TEXT = ", ".join(f"{_by_metric(c)} AS {c}" for c in ("pre", "post", "prevs_post", "last_year_pre_vs_post")) + f", {_pct('growth_pct')} AS growth_pct"
SQL["display_summary"] = f"SELECT platform, metric, metric_order, {_TEXT} FROM ({ORACLE['platform_summary_pre_post']})"
SQL["display_campaigns"] = (f"SELECT channel, campaign_key, campaign_label, {_int('orders')} AS orders, {_money('sales', 2)} AS sales, {_money('spend', 2)} AS spend, "
                            f"format('{{:,.2f}}', round_even(roas, 2)) AS roas, {_money('cost_per_order', 2)} AS cost_per_order FROM ({ORACLE['campaign_promotion']})")
SQL["display_store_table"] = ("SELECT platform, store_id, " + ", ".join(f"{_money(c)} AS {c}" for c in ("pre", "post", "prevs_post", "last_year_pre_vs_post"))
                              + f", {_pct('growth_pct')} AS growth_pct FROM ({ORACLE['store_table_pre_post']})")

_DISPLAY = ("display_summary", "display_campaigns", "display_store_table")
ORACLE.update({k: v if k in _DISPLAY else _wrap_round(v) for k, v in SQL.items()})
