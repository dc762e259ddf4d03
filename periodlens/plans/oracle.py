"""Independent SQL formulation of every registered query (DuckDB dialect).

These statements are the correctness oracle: they restate each report with
plain joins, ``COUNT(DISTINCT ...)`` and ``CASE`` over the raw tables, with
no code shared with the Spark operators beyond the fixed parameters.
Rounding is ``round_even`` (half to even), applied to DECIMAL values where
the reports round exact totals and to DOUBLE values for percentages.
"""

from __future__ import annotations

import datetime as dt

from ..sources import testviews as tv

ORACLE: dict[str, str] = {}

P = tv.LINEITEM_PARAMS
PE = tv.EVENTS_PARAMS
WIN = ("pre_24", "post_24", "pre_25", "post_25")


def d(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def between(col: str, params, period: str) -> str:
    s, e = params.windows[period]
    return f"{col} BETWEEN {d(s)} AND {d(e)}"


def any_window(col: str, params, periods=WIN) -> str:
    return "(" + " OR ".join(between(col, params, p) for p in periods) + ")"


def not_excluded(col: str, params) -> str:
    if not params.excluded:
        return "TRUE"
    return f"{col} NOT IN (" + ", ".join(d(x) for x in params.excluded) + ")"


ORDER_FACT = """
SELECT CASE l_linestatus WHEN 'F' THEN 'DD' WHEN 'O' THEN 'UE' END AS platform,
       CAST(l_suppkey AS VARCHAR) AS store_id,
       l_orderkey AS order_id,
       CAST(l_shipdate AS DATE) AS event_date,
       CAST(l_extendedprice AS DECIMAL(18,4)) AS sales,
       CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))
            AS DECIMAL(18,4)) AS payouts
FROM lineitem WHERE l_linestatus IN ('F', 'O')
"""

SELECTED = "SELECT CAST(s_suppkey AS VARCHAR) AS store_id FROM supplier WHERE s_acctbal > 0"


def rows_cte(params=P, fact=ORDER_FACT) -> str:
    return (f"f AS ({fact}), r AS (SELECT * FROM f WHERE {any_window('event_date', params)} "
            f"AND {not_excluded('event_date', params)})")


def totals_select(params=P, metric: str = "sales") -> str:
    if metric == "orders":
        cols = ",\n  ".join(
            f"CAST(COUNT(DISTINCT CASE WHEN {between('event_date', params, p)} THEN order_id END)"
            f" AS DECIMAL(28,4)) AS {p}" for p in WIN)
    else:
        cols = ",\n  ".join(
            f"COALESCE(SUM(CASE WHEN {between('event_date', params, p)} THEN {metric} END), 0) AS {p}"
            for p in WIN)
    return f"SELECT platform, store_id, '{metric}' AS metric,\n  {cols}\nFROM r GROUP BY platform, store_id"


def totals_cte(params=P, metric: str = "sales") -> str:
    return f"t AS ({totals_select(params, metric)})"


def pct_den_one(delta: str, den: str) -> str:
    return (f"round_even(CAST({delta} AS DOUBLE) / CAST(CASE WHEN {den} = 0 THEN 1 ELSE {den} END"
            f" AS DOUBLE) * 100, 1)")


def pct_or_zero(delta: str, den: str) -> str:
    return (f"round_even(CASE WHEN {den} = 0 THEN 0.0 ELSE CAST({delta} AS DOUBLE) / "
            f"CAST({den} AS DOUBLE) * 100 END, 1)")


def compare_select(src: str = "t", as_double: bool = True) -> str:
    """Rounded comparison columns from unrounded window totals."""
    def cast(x):
        return f"CAST({x} AS DOUBLE)" if as_double else x
    return f"""SELECT platform, store_id, metric,
  {cast('round_even(pre_24, 1)')} AS pre_24, {cast('round_even(post_24, 1)')} AS post_24,
  {cast('round_even(pre_25, 1)')} AS pre_25, {cast('round_even(post_25, 1)')} AS post_25,
  {cast('round_even(post_25 - pre_25, 1)')} AS prevs_post,
  {cast('round_even(post_24 - pre_24, 1)')} AS last_year_pre_vs_post,
  {cast('round_even(post_25 - post_24, 1)')} AS yoy,
  {pct_den_one('post_25 - pre_25', 'pre_25')} AS growth_pct,
  {pct_den_one('post_25 - post_24', 'post_24')} AS yoy_pct
FROM {src}"""


def store_compare_sql(metric: str, params=P) -> str:
    return f"WITH {rows_cte(params)},\n{totals_cte(params, metric)}\n{compare_select()}"


def compare_dec_cte(params=P, metrics=("sales", "payouts", "orders")) -> str:
    """CTE ``c``: rounded DECIMAL comparison rows for all metrics."""
    parts = []
    for m in metrics:
        parts.append(f"t_{m} AS ({totals_select(params, m)})")
    union = " UNION ALL ".join(f"SELECT * FROM t_{m}" for m in metrics)
    return (f"{rows_cte(params)},\n" + ",\n".join(parts)
            + f",\nt AS ({union}),\nc AS ({compare_select('t', as_double=False)})")


ORACLE["store_compare_sales"] = store_compare_sql("sales")
ORACLE["store_compare_payouts"] = store_compare_sql("payouts")
ORACLE["store_compare_orders"] = store_compare_sql("orders")


# ====================================================================== shared

def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r1(x: str) -> str:
    return f"CAST(round_even({x}, 1) AS DOUBLE)"


def sel_filter(col: str = "store_id") -> str:
    return f"{col} IN ({SELECTED})"


def compare_ctes(params=P, metrics=("sales", "payouts", "orders")) -> str:
    return compare_dec_cte(params, metrics)


CAMPAIGN_FACT = """
SELECT CASE l_linestatus WHEN 'F' THEN 'promotion' WHEN 'O' THEN 'sponsored' END AS channel,
       CAST(l_suppkey AS VARCHAR) AS store_id,
       CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN 'false' ELSE l_returnflag END AS campaign_key,
       CAST(l_shipdate AS DATE) AS event_date,
       CAST(l_quantity AS DECIMAL(18,4)) AS orders,
       CAST(l_extendedprice AS DECIMAL(18,4)) AS sales,
       CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS spend,
       CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS new_customers
FROM lineitem WHERE l_linestatus IN ('F', 'O')
"""

SLOT_FACT = """
SELECT CASE WHEN event_type IN ('purchase', 'view') THEN 'DD' ELSE 'UE' END AS platform,
       CAST(user_id AS VARCHAR) AS store_id,
       event_id AS order_id,
       CAST(ts AS DATE) AS event_date,
       hour(ts) * 60 + minute(ts) AS minute_of_day,
       CAST(value AS DECIMAL(18,4)) AS sales,
       CAST(CAST(value AS DECIMAL(18,4)) * CAST(0.85 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS payouts
FROM events
"""


def window_sums(metric: str, params=P, periods=WIN) -> str:
    return ", ".join(
        f"COALESCE(SUM(CASE WHEN {between('event_date', params, p)} THEN {metric} END), 0) AS {p}"
        for p in periods)


def deltas() -> str:
    return ("post_25 - pre_25 AS prevs_post, post_24 - pre_24 AS last_year_pre_vs_post, "
            "post_25 - post_24 AS yoy")


def nc_cte(params=P) -> str:
    """``nc``: DD new customers per store (promotion rows), unrounded."""
    return (f"cf AS ({CAMPAIGN_FACT}),\n"
            f"ncr AS (SELECT * FROM cf WHERE channel = 'promotion' AND new_customers IS NOT NULL "
            f"AND store_id IS NOT NULL AND {any_window('event_date', params)} "
            f"AND {not_excluded('event_date', params)}),\n"
            f"nc0 AS (SELECT store_id, {window_sums('new_customers', params)} FROM ncr GROUP BY store_id),\n"
            f"nc AS (SELECT store_id, pre_24, post_24, pre_25, post_25, {deltas()} FROM nc0)")


def ue_nc_cte(params=P) -> str:
    """``uenc``: UE platform-level new customers per window (no day exclusion)."""
    return (f"uer AS (SELECT CAST(l_shipdate AS DATE) AS event_date, "
            f"CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS new_customers "
            f"FROM lineitem WHERE l_linestatus = 'O'),\n"
            f"uer2 AS (SELECT * FROM uer WHERE {any_window('event_date', params)}),\n"
            f"uenc0 AS (SELECT {window_sums('new_customers', params)} FROM uer2),\n"
            f"uenc AS (SELECT pre_24, post_24, pre_25, post_25, {deltas()} FROM uenc0)")


SUMC = ("pre_24", "post_24", "pre_25", "post_25", "prevs_post", "last_year_pre_vs_post", "yoy")
BASE = ("sales", "payouts", "orders", "new_customers")
NAMES = {"sales": "Sales", "payouts": "Payouts", "orders": "Orders", "new_customers": "New Customers",
         "profitability": "Profitability", "average_check": "Average Check"}
ORDER = ("sales", "payouts", "orders", "new_customers", "profitability", "average_check")


def long_cte(with_ue_nc: bool, keep: str | None = None) -> str:
    cols = ", ".join(SUMC)
    parts = [f"SELECT platform, metric, {cols} FROM c WHERE {keep or sel_filter()}",
             f"SELECT 'DD' AS platform, 'new_customers' AS metric, {cols} FROM nc"]
    if with_ue_nc:
        parts.append(f"SELECT 'UE' AS platform, 'new_customers' AS metric, {cols} FROM uenc")
    return "l AS (" + "\nUNION ALL ".join(parts) + ")"


def totals_by(keys: str) -> str:
    aggs = ",\n  ".join(
        f"COALESCE(SUM(CASE WHEN metric = '{m}' THEN {c} END), 0) AS {m}_{c}"
        for m in BASE for c in SUMC)
    grp = f" GROUP BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"m AS (SELECT {sel}{aggs}\nFROM l{grp})"


def pz(delta: str, den: str) -> str:
    """Percent, zero when the denominator is zero (doubles)."""
    return f"CASE WHEN {den} = 0 THEN 0.0 ELSE {dbl(delta)} / {dbl(den)} * 100 END"


def summary_rows(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    parts = []
    for i, m in enumerate(BASE):
        parts.append(
            f"SELECT {k}'{NAMES[m]}' AS metric, {i} AS metric_order, "
            f"{r1(m + '_pre_25')} AS pre, {r1(m + '_post_25')} AS post, "
            f"{r1(m + '_prevs_post')} AS prevs_post, "
            f"{r1(m + '_last_year_pre_vs_post')} AS last_year_pre_vs_post, "
            f"round_even({pz(m + '_prevs_post', m + '_pre_25')}, 1) AS growth_pct, "
            f"{r1(m + '_post_24')} AS last_year_post, {r1(m + '_yoy')} AS yoy, "
            f"round_even({pz(m + '_yoy', m + '_post_24')}, 1) AS yoy_pct FROM m")

    def ratio_row(name, num, den, scale, idx):
        def rat(p):
            n, d_ = r1(f"{num}_{p}"), r1(f"{den}_{p}")
            core = f"{n} / {d_}" + (f" * {scale}" if scale != 1 else "")
            return f"(CASE WHEN {d_} = 0 THEN 0.0 ELSE {core} END)"
        pre, post, lpre, lpost = rat("pre_25"), rat("post_25"), rat("pre_24"), rat("post_24")
        return (f"SELECT {k}'{NAMES[name]}' AS metric, {idx} AS metric_order, "
                f"round_even({pre}, 1) AS pre, round_even({post}, 1) AS post, "
                f"round_even({post} - {pre}, 1) AS prevs_post, "
                f"round_even({lpost} - {lpre}, 1) AS last_year_pre_vs_post, "
                f"round_even(CASE WHEN {pre} = 0 THEN 0.0 ELSE ({post} - {pre}) / {pre} * 100.0 END, 1)"
                f" AS growth_pct, "
                f"round_even({lpost}, 1) AS last_year_post, round_even({post} - {lpost}, 1) AS yoy, "
                f"round_even(CASE WHEN {lpost} = 0 THEN 0.0 ELSE ({post} - {lpost}) / {lpost} * 100.0 END, 1)"
                f" AS yoy_pct FROM m")
    parts.append(ratio_row("profitability", "payouts", "sales", "100.0", 4))
    parts.append(ratio_row("average_check", "sales", "orders", 1, 5))
    return "sm AS (" + "\nUNION ALL ".join(parts) + ")"


def platform_summary_ctes(keep: str | None = None) -> str:
    return with_(compare_ctes(), nc_cte(), long_cte(False, keep), totals_by("platform"),
                 summary_rows("platform"))


def combined_summary_ctes() -> str:
    return with_(compare_ctes(), nc_cte(), ue_nc_cte(), long_cte(True), totals_by(""),
                 summary_rows(""))


T1 = "pre, post, prevs_post, last_year_pre_vs_post, growth_pct"
T2 = "last_year_post, post, yoy, yoy_pct"

# ====================================================================== R1 (excluded as data)

_SUNDAY_RULE = "dayofweek(event_date) <> 0"


def _rows_cte_sundays(params=P) -> str:
    return (f"f AS ({ORDER_FACT}), r AS (SELECT * FROM f WHERE {any_window('event_date', params)} "
            f"AND {not_excluded('event_date', params)} AND {_SUNDAY_RULE})")


def _excluded_compare() -> str:
    parts = [f"t_{m} AS ({totals_select(P, m)})" for m in ("sales", "payouts", "orders")]
    union = " UNION ALL ".join(f"SELECT * FROM t_{m}" for m in ("sales", "payouts", "orders"))
    return with_(_rows_cte_sundays(), *parts, f"t AS ({union})") + compare_select("t")


ORACLE["store_compare_excluded"] = _excluded_compare()

# ====================================================================== R2, R6

_T1_DEC = (f"t1 AS (SELECT platform, store_id, pre_25 AS pre, post_25 AS post, prevs_post, "
           f"last_year_pre_vs_post, growth_pct FROM c WHERE metric = 'sales' AND {sel_filter()} "
           f"AND store_id IS NOT NULL AND store_id <> '' AND (pre_25 <> 0 OR post_25 <> 0))")
_T2_DEC = (f"t2 AS (SELECT platform, store_id, post_24 AS last_year_post, post_25 AS post, yoy, "
           f"yoy_pct FROM c WHERE metric = 'sales' AND {sel_filter()} "
           f"AND store_id IS NOT NULL AND store_id <> '' AND (post_24 <> 0 OR post_25 <> 0))")

ORACLE["store_table_pre_post"] = (
    with_(compare_ctes(), _T1_DEC)
    + f"SELECT platform, store_id, {dbl('pre')} AS pre, {dbl('post')} AS post, "
      f"{dbl('prevs_post')} AS prevs_post, {dbl('last_year_pre_vs_post')} AS last_year_pre_vs_post, "
      f"growth_pct FROM t1")
ORACLE["store_table_yoy"] = (
    with_(compare_ctes(), _T2_DEC)
    + f"SELECT platform, store_id, {dbl('last_year_post')} AS last_year_post, {dbl('post')} AS post, "
      f"{dbl('yoy')} AS yoy, yoy_pct FROM t2")
ORACLE["combined_store_pre_post"] = (
    with_(compare_ctes(P, ("sales",)), _T1_DEC,
          "s AS (SELECT store_id, SUM(pre) AS pre, SUM(post) AS post, SUM(prevs_post) AS prevs_post, "
          "SUM(last_year_pre_vs_post) AS ly FROM t1 GROUP BY store_id)")
    + f"SELECT store_id, {dbl('pre')} AS pre, {dbl('post')} AS post, {dbl('prevs_post')} AS prevs_post, "
      f"{dbl('ly')} AS last_year_pre_vs_post, round_even({pz('prevs_post', 'pre')}, 1) AS growth_pct "
      f"FROM s WHERE store_id <> '' AND (pre <> 0 OR post <> 0)")
ORACLE["combined_store_yoy"] = (
    with_(compare_ctes(P, ("sales",)), _T2_DEC,
          "s AS (SELECT store_id, SUM(last_year_post) AS lyp, SUM(post) AS post, SUM(yoy) AS yoy "
          "FROM t2 GROUP BY store_id)")
    + f"SELECT store_id, {dbl('lyp')} AS last_year_post, {dbl('post')} AS post, {dbl('yoy')} AS yoy, "
      f"round_even({pz('yoy', 'lyp')}, 1) AS yoy_pct "
      f"FROM s WHERE store_id <> '' AND (lyp <> 0 OR post <> 0)")

# ====================================================================== R4, R5

ORACLE["platform_summary_pre_post"] = (
    platform_summary_ctes()
    + f"SELECT platform, metric, metric_order, {T1} FROM sm "
      f"WHERE metric <> 'New Customers' OR platform = 'DD'")
ORACLE["platform_summary_yoy"] = (
    platform_summary_ctes()
    + f"SELECT platform, metric, metric_order, {T2} FROM sm "
      f"WHERE metric <> 'New Customers' OR platform = 'DD'")
ORACLE["combined_summary_pre_post"] = combined_summary_ctes() + f"SELECT metric, metric_order, {T1} FROM sm"
ORACLE["combined_summary_yoy"] = combined_summary_ctes() + f"SELECT metric, metric_order, {T2} FROM sm"

# ====================================================================== R7, R8

_SUMC_DBL = ", ".join(f"{dbl(c)} AS {c}" for c in SUMC)
ORACLE["new_customers_by_store"] = with_(nc_cte()) + f"SELECT store_id, {_SUMC_DBL} FROM nc"
ORACLE["new_customers_totals"] = with_(ue_nc_cte()) + f"SELECT {_SUMC_DBL} FROM uenc"

# ====================================================================== R9


def _label(k: str) -> str:
    lk = f"lower(trim({k}))"
    return (f"CASE WHEN {lk} IN ('false', '0') THEN 'Corporate' WHEN {lk} IN ('true', '1') THEN 'TODC' "
            f"ELSE {k} END")


_CAMP_ROWS = (f"cf AS ({CAMPAIGN_FACT}),\n"
              f"cr AS (SELECT * FROM cf WHERE {between('event_date', P, 'post_25')} "
              f"AND {not_excluded('event_date', P)} AND campaign_key IS NOT NULL)")


def _campaign_select(keys: str) -> str:
    return (f"SELECT {keys}, {_label('campaign_key')} AS campaign_label, "
            f"{dbl('orders')} AS orders, {dbl('sales')} AS sales, {dbl('spend')} AS spend, "
            f"CASE WHEN spend = 0 THEN 0.0 ELSE {dbl('sales')} / {dbl('spend')} END AS roas, "
            f"CASE WHEN orders = 0 THEN 0.0 ELSE {dbl('spend')} / {dbl('orders')} END AS cost_per_order")


for _ch in ("promotion", "sponsored"):
    ORACLE[f"campaign_{_ch}"] = (
        with_(_CAMP_ROWS, f"ca AS (SELECT channel, campaign_key, COALESCE(SUM(orders), 0) AS orders, "
                          f"COALESCE(SUM(sales), 0) AS sales, COALESCE(SUM(spend), 0) AS spend FROM cr "
                          f"WHERE channel = '{_ch}' GROUP BY channel, campaign_key)")
        + _campaign_select("channel, campaign_key") + " FROM ca")
ORACLE["campaign_combined"] = (
    with_(_CAMP_ROWS, "ca AS (SELECT campaign_key, COALESCE(SUM(orders), 0) AS orders, "
                      "COALESCE(SUM(sales), 0) AS sales, COALESCE(SUM(spend), 0) AS spend FROM cr "
                      "WHERE channel IN ('promotion', 'sponsored') GROUP BY campaign_key)")
    + _campaign_select("campaign_key") + " FROM ca")

# ====================================================================== R3

_SLOT_NAMES = ("Overnight", "Breakfast", "Lunch", "Afternoon", "Dinner", "Late night")


def _slot_case(cuts) -> str:
    arms = " ".join(f"WHEN minute_of_day < {c} THEN '{n}'" for n, c in zip(_SLOT_NAMES, cuts))
    return f"CASE WHEN minute_of_day IS NULL OR minute_of_day < 0 THEN NULL {arms} ELSE 'Late night' END"


_DD_CUTS = (300, 659, 839, 959, 1159)
_STD_CUTS = (300, 660, 840, 1020, 1200)
_GRID = ("grid AS (SELECT * FROM (VALUES "
         + ", ".join(f"('{p}', '{n}', {i})" for p in ("DD", "UE") for i, n in enumerate(_SLOT_NAMES))
         + ") AS g(platform, slot, slot_order))")


def _slot_ctes(dd_cuts=_DD_CUTS, ue_cuts=_STD_CUTS) -> str:
    per = ("pre_25", "post_25", "post_24")
    sums = ", ".join(f"SUM(CASE WHEN {between('event_date', PE, p)} THEN {m} END) AS {m}_{p}"
                     for p in per for m in ("sales", "payouts"))
    slot = (f"CASE WHEN platform = 'DD' THEN {_slot_case(dd_cuts)} "
            f"WHEN platform = 'UE' THEN {_slot_case(ue_cuts)} ELSE {_slot_case(_STD_CUTS)} END")
    zero = ", ".join(f"COALESCE(a.{m}_{p}, 0) AS {m}_{p}" for p in per for m in ("sales", "payouts"))
    return with_(
        f"sf AS ({SLOT_FACT})",
        f"sr AS (SELECT *, {slot} AS slot FROM sf WHERE {any_window('event_date', PE, per)} "
        f"AND {not_excluded('event_date', PE)})",
        f"sa AS (SELECT platform, slot, {sums} FROM sr WHERE slot IS NOT NULL GROUP BY platform, slot)",
        _GRID,
        f"st AS (SELECT g.platform, g.slot, g.slot_order, {zero} FROM grid g "
        f"LEFT JOIN sa a ON a.platform = g.platform AND a.slot = g.slot)")


def _slot_pre_post(m: str) -> str:
    pre, post = f"{m}_pre_25", f"{m}_post_25"
    return (f"SELECT platform, slot, slot_order, {dbl(pre)} AS pre, {dbl(post)} AS post, "
            f"{dbl(f'{post} - {pre}')} AS pre_vs_post, round_even({pz(f'{post} - {pre}', pre)}, 1) AS growth_pct "
            f"FROM st")


def _slot_yoy(m: str) -> str:
    ly, post = f"{m}_post_24", f"{m}_post_25"
    return (f"SELECT platform, slot, slot_order, {dbl(ly)} AS last_year_post, {dbl(post)} AS post, "
            f"{dbl(f'{post} - {ly}')} AS yoy, round_even({pz(f'{post} - {ly}', ly)}, 1) AS growth_pct "
            f"FROM st")


ORACLE["slot_sales_pre_post"] = _slot_ctes() + _slot_pre_post("sales")
ORACLE["slot_sales_yoy"] = _slot_ctes() + _slot_yoy("sales")
ORACLE["slot_payouts_pre_post"] = _slot_ctes() + _slot_pre_post("payouts")
ORACLE["slot_payouts_yoy"] = _slot_ctes() + _slot_yoy("payouts")
ORACLE["slot_standard_bounds"] = _slot_ctes(_STD_CUTS, _STD_CUTS) + _slot_pre_post("sales")

# ====================================================================== R20


def _period_values(params=P, periods=WIN) -> str:
    w = params.windows
    vals = ", ".join(f"('{p}', {i}, {d(w[p][0])}, {d(w[p][1])})" for i, p in enumerate(WIN)
                     if p in periods)
    return f"pd AS (SELECT * FROM (VALUES {vals}) AS v(period, period_order, start_date, end_date))"


_CELLS = with_(
    rows_cte(P), _period_values(),
    "cells AS (SELECT platform, period, event_date, store_id, COALESCE(SUM(sales), 0) AS sales, "
    "COALESCE(SUM(payouts), 0) AS payouts, COUNT(DISTINCT order_id) AS orders "
    "FROM r JOIN pd ON r.event_date BETWEEN pd.start_date AND pd.end_date "
    "GROUP BY platform, period, event_date, store_id)")
ORACLE["daily_store_sales"] = _CELLS + f"SELECT platform, period, event_date, store_id, {dbl('sales')} AS sales FROM cells"
ORACLE["daily_store_payouts"] = (_CELLS + f"SELECT platform, period, event_date, store_id, "
                                           f"{dbl('payouts')} AS payouts FROM cells")
ORACLE["daily_store_orders"] = _CELLS + "SELECT platform, period, event_date, store_id, orders FROM cells"
ORACLE["daily_store_cube"] = (
    _CELLS + "SELECT platform, period, event_date, store_id, "
             "CAST(grouping(event_date) AS INTEGER) AS is_total_row, "
             "CAST(grouping(store_id) AS INTEGER) AS is_total_col, "
             "CAST(SUM(sales) AS DOUBLE) AS sales, CAST(SUM(payouts) AS DOUBLE) AS payouts, "
             "CAST(SUM(orders) AS BIGINT) AS orders FROM cells GROUP BY GROUPING SETS ("
             "(platform, period, event_date, store_id), (platform, period, event_date), "
             "(platform, period, store_id), (platform, period))")

_WIDE_COLS = ", ".join(
    [f"CAST(COALESCE(SUM(CASE WHEN store_id = '{i}' THEN v END), 0) AS DOUBLE) AS \"{i}\"" for i in tv.WIDE_STORES]
    + ["CAST(COALESCE(SUM(CASE WHEN store_id NOT IN (" + ", ".join(f"'{i}'" for i in tv.WIDE_STORES)
       + ") THEN v END), 0) AS DOUBLE) AS \"Other\"", "CAST(COALESCE(SUM(v), 0) AS DOUBLE) AS \"Total\""])
ORACLE["daily_store_wide"] = (
    _CELLS.rstrip("\n") + ",\nlong AS ("
    + " UNION ALL ".join(f"SELECT platform, period, event_date, store_id, '{m}' AS metric, CAST({m} AS DECIMAL(28,4)) AS v FROM cells"
                         for m in ("sales", "payouts", "orders"))
    + f")\nSELECT platform, period, metric, event_date, {_WIDE_COLS} FROM long "
      "GROUP BY platform, period, metric, event_date "
      f"UNION ALL SELECT platform, period, metric, CAST(NULL AS DATE) AS event_date, {_WIDE_COLS} FROM long "
      "GROUP BY platform, period, metric")

# ====================================================================== R10-R19, R22

# the selection counts and is listed by itself, whether or not a store has rows
_SEL_BOTH = (f"SELECT p.platform, s.store_id FROM (SELECT DISTINCT store_id FROM ({SELECTED})) s, "
             "(VALUES ('DD'), ('UE')) AS p(platform)")
_COUNTS = (f"selected AS ({_SEL_BOTH}), cnt AS (SELECT p.platform, "
           "(SELECT COUNT(*) FROM selected WHERE selected.platform = p.platform) AS selected_stores, "
           "(SELECT COUNT(DISTINCT store_id) FROM c WHERE metric = 'sales' AND c.platform = p.platform) AS total_stores "
           "FROM (VALUES ('DD'), ('UE')) AS p(platform))")
_KPI = ("kpi AS (SELECT "
        "COALESCE((SELECT growth_pct FROM sm WHERE metric = 'Sales'), 0.0) AS sales_growth_pct, "
        "COALESCE((SELECT yoy_pct FROM sm WHERE metric = 'Sales'), 0.0) AS sales_yoy_pct, "
        "COALESCE((SELECT growth_pct FROM sm WHERE metric = 'Orders'), 0.0) AS order_growth_pct, "
        "COALESCE((SELECT growth_pct FROM sm WHERE metric = 'New Customers'), 0.0) AS new_customer_growth_pct, "
        "COALESCE((SELECT selected_stores FROM cnt WHERE platform = 'DD'), 0) AS dd_selected_stores, "
        "COALESCE((SELECT prevs_post FROM sm WHERE metric = 'Payouts'), 0.0) / "
        "CAST(GREATEST(1, COALESCE((SELECT selected_stores FROM cnt WHERE platform = 'DD'), 0)) AS DOUBLE)"
        " AS payout_lift_per_store)")
_KPI_CTES = combined_summary_ctes().rstrip("\n") + ",\n" + _COUNTS + ",\n" + _KPI + "\n"
ORACLE["kpis"] = _KPI_CTES + "SELECT * FROM kpi"


def _pct_txt(x: str) -> str:
    return f"printf('%.1f', round_even({x}, 1)) || '%'"


def _rng(a, b) -> str:
    return f"{a.month:02d}/{a.day:02d}/{a.year} - {b.month:02d}/{b.day:02d}/{b.year}"


_money = ("CASE WHEN round_even(payout_lift_per_store, 1) < 0 THEN '-$' ELSE '$' END || "
          "format('{:,.1f}', abs(round_even(payout_lift_per_store, 1)))")
ORACLE["summary_metrics"] = _KPI_CTES + (
    "SELECT * FROM (VALUES "
    "(0, 'Active Stores', (SELECT 'DoorDash: ' || CAST(COALESCE((SELECT selected_stores FROM cnt WHERE "
    "platform = 'DD'), 0) AS VARCHAR) || '  |  UberEats: ' || CAST(COALESCE((SELECT selected_stores FROM cnt "
    "WHERE platform = 'UE'), 0) AS VARCHAR))), "
    f"(1, 'Pre Period', '{_rng(P.pre_start, P.pre_end)}'), "
    f"(2, 'Post Period', '{_rng(P.post_start, P.post_end)}'), "
    f"(3, 'Sales Growth (Pre→Post)', (SELECT {_pct_txt('sales_growth_pct')} FROM kpi)), "
    f"(4, 'Sales Growth (YoY)', (SELECT {_pct_txt('sales_yoy_pct')} FROM kpi)), "
    f"(5, 'Order Growth', (SELECT {_pct_txt('order_growth_pct')} FROM kpi)), "
    f"(6, 'New Customer Growth', (SELECT {_pct_txt('new_customer_growth_pct')} FROM kpi)), "
    f"(7, 'Payout Lift per Store', (SELECT {_money} FROM kpi)), "
    "(8, 'Average Markup', ''), (9, 'Pre TODC Growth YoY', '')"
    ") AS v(row_order, metric, value)")
ORACLE["store_coverage"] = (with_(compare_ctes(P, ("sales",)), _COUNTS)
                            + "SELECT platform, selected_stores, total_stores FROM cnt")
ORACLE["store_directory"] = (
    f"SELECT store_id, CASE WHEN MIN(CASE WHEN platform = 'DD' THEN 0 ELSE 1 END) = 0 THEN 'DD' "
    f"ELSE 'UE' END AS first_platform, '' AS markups FROM ({_SEL_BOTH}) GROUP BY store_id")


def _mover_cols(pre: str, post: str) -> str:
    chg = f"({dbl(post)} - {dbl(pre)})"
    return (f"round_even({dbl(pre)}, 1) AS pre, round_even({dbl(post)}, 1) AS post, "
            f"round_even({chg}, 1) AS change, "
            f"round_even(CASE WHEN {dbl(pre)} = 0 THEN 0.0 ELSE {chg} / {dbl(pre)} * 100 END, 1) AS change_pct, "
            f"CASE WHEN {chg} > 0 THEN 'Gain' WHEN {chg} < 0 THEN 'Loss' ELSE 'No Change' END AS direction")


ORACLE["summary_movers"] = combined_summary_ctes() + f"SELECT metric, {_mover_cols('pre', 'post')} FROM sm"

# one selection per platform
ORACLE["summary_movers_platform"] = (
    platform_summary_ctes(f"((platform = 'DD' AND {sel_filter()}) OR (platform = 'UE' AND store_id IN "
                          "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0)))")
    + f"SELECT platform, metric, {_mover_cols('pre', 'post')} FROM sm WHERE metric <> 'New Customers' OR platform = 'DD'")

_COMB_T1 = ("s AS (SELECT store_id, SUM(pre) AS pre, SUM(post) AS post FROM t1 GROUP BY store_id), "
            "comb AS (SELECT store_id, CAST(pre AS DOUBLE) AS pre, CAST(post AS DOUBLE) AS post FROM s "
            "WHERE store_id <> '' AND (pre <> 0 OR post <> 0))")
ORACLE["store_movers_top20"] = (
    with_(compare_ctes(P, ("sales",)), _T1_DEC, _COMB_T1,
          f"allrows AS (SELECT 'Combined' AS source, 0 AS source_rank, store_id, {_mover_cols('pre', 'post')} "
          f"FROM comb UNION ALL SELECT 'DoorDash', 1, store_id, {_mover_cols('pre', 'post')} FROM t1 "
          f"WHERE platform = 'DD' UNION ALL SELECT 'UberEats', 2, store_id, {_mover_cols('pre', 'post')} "
          f"FROM t1 WHERE platform = 'UE')")
    + "SELECT source, store_id, pre, post, change, change_pct, direction FROM allrows "
      "WHERE source_rank = (SELECT MIN(source_rank) FROM allrows) "
      "ORDER BY abs(change) DESC, store_id LIMIT 20")
ORACLE["slot_movers"] = (_slot_ctes().rstrip("\n")
                         + ",\nsp AS (" + _slot_pre_post("sales") + " WHERE platform = 'DD')\n"
                         + f"SELECT slot, {_mover_cols('pre', 'post')} FROM sp")
_PT = ("pt AS (SELECT platform, COALESCE(SUM(pre_25), 0) AS pre, COALESCE(SUM(post_25), 0) AS post "
       "FROM c WHERE metric = 'sales' GROUP BY platform)")
ORACLE["platform_movers"] = (with_(compare_ctes(P, ("sales",)), _PT)
                             + f"SELECT platform, {_mover_cols('pre', 'post')} FROM pt")
ORACLE["platform_growth"] = (with_(compare_ctes(P, ("sales",)), _PT)
                             + f"SELECT platform, round_even({pz('post - pre', 'pre')}, 1) AS growth_pct FROM pt")


def _top_bottom(src: str, value: str, name: str, k: int, cols: str) -> str:
    return (f"SELECT platform, 'worst' AS kind, CAST(rn AS INTEGER) AS rank, {cols} FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {value} ASC, {name} ASC) AS rn "
            f"FROM {src}) WHERE rn <= {k} "
            f"UNION ALL SELECT platform, 'best' AS kind, CAST(rn AS INTEGER) AS rank, {cols} FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {value} DESC, {name} ASC) AS rn "
            f"FROM {src}) WHERE rn <= {k}")


ORACLE["best_worst_stores"] = (
    with_(rows_cte(P), totals_cte(P, "sales"), f"cd AS ({compare_select('t')})")
    + _top_bottom("cd", "growth_pct", "store_id", 3, "store_id, growth_pct"))
ORACLE["best_worst_dates"] = (
    with_(f"f AS ({ORDER_FACT})",
          f"ds AS (SELECT platform, event_date, CAST(COALESCE(SUM(sales), 0) AS DOUBLE) AS sales FROM f "
          f"WHERE {between('event_date', P, 'post_25')} AND {not_excluded('event_date', P)} "
          f"GROUP BY platform, event_date)")
    + _top_bottom("ds", "sales", "event_date", 5, "event_date, sales"))

# ====================================================================== P2, P3, J5-J7, S10

ORACLE["period_dim"] = (
    with_(rows_cte(P), _period_values(),
          "cov AS (SELECT period, COUNT(*) AS rows, MIN(event_date) AS first_date, "
          "MAX(event_date) AS last_date FROM r JOIN pd ON r.event_date BETWEEN pd.start_date AND pd.end_date "
          "GROUP BY period)")
    + "SELECT pd.period, CAST(pd.period_order AS INTEGER) AS period_order, pd.start_date, pd.end_date, "
      "CAST(date_diff('day', pd.start_date, pd.end_date) + 1 AS INTEGER) AS days, "
      "COALESCE(cov.rows, 0) AS rows, cov.first_date, cov.last_date, "
      f"{d(P.suggested_download[0])} AS download_from, {d(P.suggested_download[1])} AS download_to "
      "FROM pd LEFT JOIN cov ON pd.period = cov.period")
ORACLE["period_tag_range_join"] = (
    with_(rows_cte(P), _period_values())
    + "SELECT platform, period, COUNT(*) AS rows, CAST(SUM(sales) AS DOUBLE) AS sales "
      "FROM r JOIN pd ON r.event_date BETWEEN pd.start_date AND pd.end_date GROUP BY platform, period")
ORACLE["excluded_anti_join"] = (
    with_(_rows_cte_sundays(), _period_values())
    + "SELECT platform, period, COUNT(*) AS rows, CAST(SUM(sales) AS DOUBLE) AS sales "
      "FROM r JOIN pd ON r.event_date BETWEEN pd.start_date AND pd.end_date GROUP BY platform, period")
ORACLE["selected_semi_join"] = (
    with_(rows_cte(P), totals_cte(P, "sales"), f"cd AS ({compare_select('t')})")
    + f"SELECT platform, store_id, pre_25, post_25 FROM cd WHERE {sel_filter()}")
ORACLE["dataset_profile"] = (
    with_(f"f AS ({ORDER_FACT})")
    + "SELECT platform, COUNT(*) AS rows, MIN(event_date) AS start_date, MAX(event_date) AS end_date, "
      "COUNT(DISTINCT store_id) AS stores, "
      "'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
      "l_tax, l_returnflag, l_linestatus' AS columns, TRUE AS date_column_found FROM f GROUP BY platform")


# ====================================================================== sign of zero
# DuckDB's round_even keeps a negative zero (round_even(-0.01, 1) = -0.0);
# Spark's bround goes through BigDecimal, which has none.  Adding 0.0 turns
# -0.0 into +0.0 and changes no other value, so every rounding is wrapped.

def _wrap_round(sql: str) -> str:
    out, i, key = [], 0, "round_even("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _wrap_round(sql[j + len(key):k])
        out.append(sql[i:j] + f"(round_even({inner}) + 0.0)")
        i = k + 1


for _k in list(ORACLE):
    ORACLE[_k] = _wrap_round(ORACLE[_k])
