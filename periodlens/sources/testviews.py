"""Mapping of the supplied Parquet tables onto the canonical facts.

The benchmark tables are a TPC-H-like star schema plus an ``events`` table.
They are mapped onto the report facts as follows:

* ``order_fact``  <- ``lineitem``: platform from ``l_linestatus`` (F -> DD,
  O -> UE), store = supplier key, order = order key, date = ship date,
  sales = extended price, payouts = extended price * (1 - discount);
* ``campaign_fact`` <- ``lineitem``: channel from ``l_linestatus`` (F ->
  promotion, O -> sponsored), campaign key from ``l_returnflag``;
* ``ue_new_customer_fact`` <- UE rows of ``lineitem`` (legacy platform-level
  new-customer files);
* ``slot_fact`` <- ``events``: the only table with a time of day;
* store selection <- ``supplier``.

All money is DECIMAL so that sums are exact.  Every fact keeps the raw
timestamp column as ``event_ts`` so that window filters reach the Parquet
scan as pushed range predicates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import MONEY
from ..params import ReportParams

# Report parameters used with the supplied tables.
LINEITEM_PARAMS = ReportParams.of(
    pre=(dt.date(1998, 1, 1), dt.date(1998, 6, 30)),
    post=(dt.date(1998, 7, 1), dt.date(1998, 12, 31)),
    excluded=(dt.date(1998, 2, 14), dt.date(1998, 7, 4), dt.date(1997, 12, 25)),
    operator="bench",
)
EVENTS_PARAMS = ReportParams.of(
    pre=(dt.date(2024, 1, 1), dt.date(2024, 1, 15)),
    post=(dt.date(2024, 1, 16), dt.date(2024, 1, 30)),
    operator="bench",
)
# Payout share of an event's value in the slot fact.
EVENT_PAYOUT_SHARE = "0.85"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The projections are SQL expression text: one JVM object per column.
_PRICE = f"CAST(l_extendedprice AS {MONEY})"


def order_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # filter on the raw status code so the predicate reaches the Parquet scan
    li = table(spark, sf_dir, "lineitem").where("l_linestatus IN ('F', 'O')")
    return li.selectExpr(
        "CASE WHEN l_linestatus = 'F' THEN 'DD' ELSE 'UE' END AS platform",
        "CAST(l_suppkey AS STRING) AS store_id",
        "l_orderkey AS order_id",
        "l_shipdate AS event_ts",
        "CAST(l_shipdate AS DATE) AS event_date",
        f"{_PRICE} AS sales",
        f"CAST({_PRICE} * (1 - CAST(l_discount AS {MONEY})) AS {MONEY}) AS payouts",
    )


def campaign_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linestatus IN ('F', 'O')")
    return li.selectExpr(
        "CASE WHEN l_linestatus = 'F' THEN 'promotion' ELSE 'sponsored' END AS channel",
        "CAST(l_suppkey AS STRING) AS store_id",
        "CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN 'false' ELSE l_returnflag END"
        " AS campaign_key",
        "l_shipdate AS event_ts",
        "CAST(l_shipdate AS DATE) AS event_date",
        f"CAST(l_quantity AS {MONEY}) AS orders",
        f"{_PRICE} AS sales",
        f"CAST({_PRICE} * CAST(l_discount AS {MONEY}) AS {MONEY}) AS spend",
        f"CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS {MONEY}) AS new_customers",
    )


def ue_new_customer_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return li.selectExpr(
        "l_shipdate AS event_ts",
        "CAST(l_shipdate AS DATE) AS event_date",
        f"CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS {MONEY}) AS new_customers",
    )


def slot_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr(
        "CASE WHEN event_type IN ('purchase', 'view') THEN 'DD' ELSE 'UE' END AS platform",
        "CAST(user_id AS STRING) AS store_id",
        "event_id AS order_id",
        "ts AS event_ts",
        "CAST(ts AS DATE) AS event_date",
        "CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute_of_day",
        f"CAST(value AS {MONEY}) AS sales",
        f"CAST(CAST(value AS {MONEY}) * CAST({EVENT_PAYOUT_SHARE} AS DECIMAL(3,2)) AS {MONEY})"
        " AS payouts",
    )


def selected_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store selection as data: suppliers with a positive account balance."""
    return (table(spark, sf_dir, "supplier").where("s_acctbal > 0")
            .selectExpr("CAST(s_suppkey AS STRING) AS store_id"))


# Stores that have a column of their own in the wide date report; the rest share ``Other``.
WIDE_STORES = tuple(str(i) for i in range(1, 11))


def selected_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection per platform as data: suppliers with a positive balance for
    DD, with an even key for UE."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS store_id",
        "explode(array_compact(array(CASE WHEN s_acctbal > 0 THEN 'DD' END, CASE WHEN s_suppkey % 2 = 0 THEN 'UE' END))) AS platform"
    ).select("platform", "store_id")


def campaign_fact_by_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign rows keyed by discount and line number: discount 0 spends nothing, and the
    lines from the fourth on have no orders."""
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").selectExpr(
        "'promotion' AS channel", "CAST(l_suppkey AS STRING) AS store_id",
        "concat(CAST(l_discount AS DECIMAL(4,2)), IF(l_linenumber > 3, '-late', '')) AS campaign_key",
        "l_shipdate AS event_ts", "CAST(l_shipdate AS DATE) AS event_date",
        f"CAST(IF(l_linenumber > 3, 0, l_quantity) AS {MONEY}) AS orders", f"{_PRICE} AS sales",
        f"CAST({_PRICE} * CAST(l_discount AS {MONEY}) AS {MONEY}) AS spend")
