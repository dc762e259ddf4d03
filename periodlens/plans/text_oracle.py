"""SQL of the queries over export text: what must come back, stated over the tables.

The statements repeat which rows carry which spelling (``sources.textexports``)
and what each spelling is worth, without reading any text."""

from __future__ import annotations

from .oracle import (ORACLE, P, _DD_CUTS, _GRID, _STD_CUTS, _campaign_select, _slot_case, _slot_yoy, _wrap_round, any_window, between, dbl,
                     not_excluded, with_)
from .text_catalog import FIRST_HALF

SQL: dict[str, str] = {}

_X = """x AS (
  SELECT *, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS y, CAST(l_extendedprice AS DECIMAL(18,4)) AS price,
    CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS paid,
    year(l_shipdate) || CASE WHEN month(l_shipdate) <= 6 THEN '-a' ELSE '-b' END || '.csv' AS half,
    l_partkey % 41 = 0 AS soon, l_partkey % 41 <> 0 AND l_partkey % 43 = 0 AS dateless,
    l_partkey % 40 = 0 AND year(l_shipdate) % 3 IN (0, 1) AS minority,
    CASE WHEN l_partkey % 47 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS store_id,
    CASE WHEN l_partkey % 23 <> 0 AND l_partkey % 29 <> 0 THEN CAST((l_orderkey * 37 + l_linenumber * 61) % 1440 AS INTEGER) END AS minute_of_day
  FROM lineitem),
v AS (
  SELECT *, CASE WHEN l_partkey % 7 = 0 THEN CASE WHEN price < 1000 THEN price END WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN price
      WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN CAST(1250 AS DECIMAL(18,4)) ELSE price END AS sales,
    CASE WHEN l_partkey % 31 <> 0 THEN paid END AS payouts, CAST(paid * 0.5 AS DECIMAL(18,4)) AS historical
  FROM x)"""


def _orders(status: str, prefix: str, hist: str, per_file: bool) -> str:
    lost = "soon OR dateless OR store_id IS NULL" + (" OR minority" if per_file else "")
    return (f"SELECT '{prefix}' || half AS file, store_id, CAST(l_orderkey AS VARCHAR) AS order_id, day AS event_date, minute_of_day, "
            f"{dbl('sales')} AS sales, {dbl('payouts')} AS payouts, {dbl(hist)} AS payouts_hist FROM v WHERE l_linestatus = '{status}' AND NOT ({lost})")


SQL["clean_orders_dd"] = with_(_X) + _orders("F", "dd-", "historical", True)
SQL["clean_orders_ue"] = with_(_X) + _orders("O", "ue-", "payouts", False)

_CAMPAIGNS = """c AS (
  SELECT CASE l_linestatus WHEN 'F' THEN 'promotion' ELSE 'sponsored' END AS channel, y, half, store_id, soon, dateless,
    CASE l_linestatus WHEN 'F' THEN 'MARKETING_PROMOTION_' ELSE 'MARKETING_SPONSORED_LISTING_' END || CASE WHEN month(day) <= 6 THEN 'a' ELSE 'b' END || '.csv' AS file,
    CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN 'false' ELSE CASE WHEN l_partkey % 37 <> 0 THEN l_returnflag END END AS campaign_key,
    CASE WHEN NOT (soon OR dateless) THEN day END AS event_date, CASE WHEN NOT (soon OR dateless OR minority) THEN day END AS nc_date,
    CASE WHEN l_partkey % 21 = 0 THEN 0 ELSE CAST(l_quantity AS DECIMAL(18,4)) END AS orders, COALESCE(sales, 0) AS sales,
    CAST(price * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS spend,
    CAST(CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DECIMAL(18,4)) AS new_customers
  FROM v WHERE l_linestatus IN ('F', 'O'))"""
SQL["clean_campaigns"] = with_(_X, _CAMPAIGNS) + (
    f"SELECT channel, file, store_id, campaign_key, event_date, nc_date, {dbl('orders')} AS orders, {dbl('sales')} AS sales, "
    f"{dbl('spend')} AS spend, {dbl('new_customers')} AS new_customers FROM c")
SQL["campaign_first_file"] = with_(
    _X, _CAMPAIGNS,
    f"ca AS (SELECT channel, campaign_key, SUM(orders) AS orders, SUM(sales) AS sales, SUM(spend) AS spend FROM c WHERE channel = 'promotion' "
    f"AND file LIKE '%\\_a.csv' ESCAPE '\\' AND campaign_key IS NOT NULL AND {between('event_date', FIRST_HALF, 'post_25')} AND {not_excluded('event_date', FIRST_HALF)} "
    "GROUP BY channel, campaign_key)") + _campaign_select("channel, campaign_key") + " FROM ca"

_SUMS = ", ".join(f"SUM(CASE WHEN {between('event_date', P, p)} THEN sales END) AS sales_{p}" for p in ("post_25", "post_24"))
SQL["slots_from_text_times"] = with_(
    _X, "sf AS (SELECT CASE l_linestatus WHEN 'F' THEN 'DD' ELSE 'UE' END AS platform, day AS event_date, minute_of_day, sales FROM v "
        "WHERE l_linestatus IN ('F', 'O') AND NOT (soon OR dateless OR store_id IS NULL OR (minority AND l_linestatus = 'F')))",
    f"sr AS (SELECT *, CASE WHEN platform = 'DD' THEN {_slot_case(_DD_CUTS)} ELSE {_slot_case(_STD_CUTS)} END AS slot FROM sf "
    f"WHERE {any_window('event_date', P, ('pre_25', 'post_25', 'post_24'))} AND {not_excluded('event_date', P)})",
    f"sa AS (SELECT platform, slot, {_SUMS} FROM sr WHERE slot IS NOT NULL GROUP BY platform, slot)", _GRID,
    "st AS (SELECT g.*, COALESCE(sales_post_25, 0) AS sales_post_25, COALESCE(sales_post_24, 0) AS sales_post_24 FROM grid g "
    "LEFT JOIN sa USING (platform, slot))") + _slot_yoy("sales")

SQL["rejects_by_reason"] = with_(
    _X, _CAMPAIGNS,
    "r AS (SELECT CASE l_linestatus WHEN 'F' THEN 'dd-' ELSE 'ue-' END || half AS file, CASE WHEN dateless THEN 'no date' WHEN soon THEN 'unreadable date' "
    "WHEN minority AND l_linestatus = 'F' THEN 'date format differs from its file' WHEN store_id IS NULL THEN 'no store' END AS reason "
    "FROM v WHERE l_linestatus IN ('F', 'O') UNION ALL "
    "SELECT 'marketing_' || y || '-01-01_' || y || '-12-31/' || file, CASE WHEN dateless THEN 'no date' WHEN soon THEN 'unreadable date' END FROM c)"
) + "SELECT file, reason, COUNT(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY file, reason"

_DD_A = "Timestamp local date, Timestamp local time, Merchant store ID, DoorDash order ID, Store name, Subtotal, Net total, Net total (for historical reference only)"
_DD_B = "Store ID, Net total, timestamp local date, Order received local time, Subtotal, DoorDash order ID, Net total (for historical reference only)"
_UE_A = "Store ID, Store Name, Order ID, Extra 0, Extra 1, Extra 2, Extra 3, Order Status, Order Date, Accept"
_UE_B = "Total payout, Sales (excl. tax), Shop ID, Extra 0, Extra 1, Extra 2, Extra 3, Order ID, Date, Time"
SQL["file_profile"] = with_(_X) + (
    f"SELECT CASE l_linestatus WHEN 'F' THEN 'dd-' ELSE 'ue-' END || half AS file, COUNT(*) AS rows, MIN(CASE WHEN NOT (soon OR dateless) THEN day END) AS start_date, "
    f"MAX(CASE WHEN NOT (soon OR dateless) THEN day END) AS end_date, CASE l_linestatus WHEN 'F' THEN CASE WHEN y % 2 = 0 THEN '{_DD_A}' ELSE '{_DD_B}' END "
    f"ELSE CASE WHEN y % 2 = 0 THEN '{_UE_A}' ELSE '{_UE_B}' END END AS columns, TRUE AS date_column_found "
    "FROM v WHERE l_linestatus IN ('F', 'O') GROUP BY l_linestatus, half, y")

_PERIODS = "pd AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', DATE '{lo}', DATE '{hi}')" for p, (lo, hi) in P.windows.items()) + ") AS t(period, lo, hi))"
_NEW = "CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DECIMAL(18,4))"
SQL["legacy_new_customers"] = with_(_X, _PERIODS) + (
    f"SELECT 'DD' AS platform, period, store_id, {dbl(f'SUM({_NEW})')} AS new_customers FROM x JOIN pd ON day BETWEEN lo AND hi "
    f"WHERE l_linestatus = 'F' AND store_id IS NOT NULL AND {not_excluded('day', P)} GROUP BY period, store_id UNION ALL "
    f"SELECT 'UE', period, NULL, {dbl(f'SUM({_NEW})')} FROM x JOIN pd ON day BETWEEN lo AND hi WHERE l_linestatus = 'O' GROUP BY period")
_C6 = "COALESCE(SUM(CASE WHEN period LIKE '%24' THEN historical ELSE payouts END), 0)"
SQL["period_files_daily"] = with_(_X, _PERIODS) + (
    f"SELECT 'DD' AS platform, period, day AS event_date, store_id, {dbl('COALESCE(SUM(sales), 0)')} AS sales, "
    f"{dbl(_C6)} AS payouts, COUNT(DISTINCT l_orderkey) AS orders "
    f"FROM v JOIN pd ON day BETWEEN lo AND hi WHERE l_linestatus = 'F' AND NOT (soon OR dateless OR minority OR store_id IS NULL) AND {not_excluded('day', P)} "
    "GROUP BY period, day, store_id")
SQL["upload_groups"] = with_(
    _X, _CAMPAIGNS,
    "u AS (SELECT *, CASE WHEN y % 2 = 0 THEN 'marketing_' || y || '-01-01_' || y || '-12-31' ELSE 'marketing_MARKETING_PROMOTION_' || y || CASE WHEN half LIKE '%a.csv' THEN '_a' ELSE '_b' END END AS upload_group, half AS f "
    "FROM c WHERE channel = 'promotion' AND NOT (soon OR dateless))") + (
    f"SELECT upload_group, COUNT(DISTINCT f) AS files, COUNT(*) AS rows, {dbl('SUM(orders)')} AS orders, {dbl('SUM(sales)')} AS sales, {dbl('SUM(spend)')} AS spend "
    "FROM u GROUP BY upload_group")

ORACLE.update({k: _wrap_round(v) for k, v in SQL.items()})
