"""Row filters and period tagging over the canonical facts.

Every filter is a Catalyst predicate, so Parquet scans receive them as pushed
filters.  Facts keep their raw timestamp as ``event_ts``; the window filter
adds a range on it (``event_ts >= first day AND event_ts < day after last``)
because a predicate on ``CAST(ts AS DATE)`` cannot be pushed to the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import PERIODS, ReportParams, in_any_window, window_flags_sql


def _ts_range(start: dt.date, end: dt.date) -> tuple:
    lo = dt.datetime.combine(start, dt.time())
    hi = dt.datetime.combine(end + dt.timedelta(days=1), dt.time())
    return lo, hi


def coarse_range(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Pushable bound on ``event_ts`` covering ``[start, end]`` (no-op if absent)."""
    if "event_ts" not in df.columns:
        return df
    lo, hi = _ts_range(start, end)
    return df.where(f"event_ts >= TIMESTAMP_NTZ'{lo:%Y-%m-%d %H:%M:%S}' "
                    f"AND event_ts < TIMESTAMP_NTZ'{hi:%Y-%m-%d %H:%M:%S}'")


def window_filter(df: DataFrame, params: ReportParams, periods: Iterable[str] = PERIODS,
                  date_col: str = "event_date") -> DataFrame:
    """Keep rows inside any of the given windows (F2; overlapping windows are fine)."""
    periods = tuple(periods)
    df = coarse_range(df, *params.span(periods))
    return df.where(in_any_window(params, date_col, periods))


def not_excluded(excluded: Iterable[dt.date], date_col: str = "event_date") -> Column:
    days = list(excluded)
    if not days:
        return F.lit(True)
    lits = ", ".join(f"DATE'{d.isoformat()}'" for d in days)
    return F.expr(f"`{date_col}` IS NOT NULL AND `{date_col}` NOT IN ({lits})")


def exclude_days(df: DataFrame, excluded: Iterable[dt.date] | DataFrame,
                 date_col: str = "event_date", within: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Drop excluded calendar days (F3): a list is an IN predicate of any
    length, a DataFrame an anti join (J5).

    A DataFrame of days is broadcast only when ``within`` bounds it to a date
    span (then it holds at most one row per day of the span); otherwise the
    join is left to adaptive execution."""
    if isinstance(excluded, DataFrame):
        days = excluded.select(F.col(excluded.columns[0]).cast("date").alias("_xday"))
        if within is not None:
            days = days.where(F.col("_xday").between(F.lit(within[0]), F.lit(within[1])))
        days = days.distinct()
        side = F.broadcast(days) if within is not None else days
        return (df.where(F.col(date_col).isNotNull())
                  .join(side, F.col(date_col) == F.col("_xday"), "left_anti"))
    days = list(excluded)
    return df.where(not_excluded(days, date_col)) if days else df


def report_rows(df: DataFrame, params: ReportParams, periods: Iterable[str] = PERIODS,
                date_col: str = "event_date") -> DataFrame:
    """Rows any report over ``periods`` can use: inside a window, not excluded."""
    return exclude_days(window_filter(df, params, periods, date_col), params.excluded, date_col)


def _in_list(store_col: str, ids: Iterable[str]) -> str:
    listed = ", ".join("'" + str(i).replace("\\", "\\\\").replace("'", "\\'") + "'" for i in ids)
    return f"`{store_col}` IN ({listed})" if listed else "FALSE"


def select_stores(df: DataFrame, stores: Iterable[str] | dict | DataFrame | None,
                  store_col: str = "store_id", platform_col: str = "platform") -> DataFrame:
    """Keep selected stores.

    ``None`` keeps all.  A list selects on every platform; a dict gives a list
    (or ``None`` for all) per platform, and platforms it does not name keep all
    their stores.  Lists are IN predicates of any length.  A DataFrame selection
    has one column of store ids, or two (platform, store id); its size is not
    known in advance, so it is a plain ``left_semi`` join that adaptive
    execution turns into a broadcast join only if the selection is small.
    """
    if stores is None:
        return df
    if isinstance(stores, DataFrame):
        names = ["_sel_platform", "_sel_store"][-len(stores.columns):]
        sel = stores.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(stores.columns, names)]).distinct()
        on = F.col(store_col) == F.col("_sel_store")
        if len(names) == 2:
            on = on & (F.col(platform_col) == F.col("_sel_platform"))
        return df.join(sel, on, "left_semi")
    if isinstance(stores, dict):
        parts = [f"(`{platform_col}` = '{p}' AND {_in_list(store_col, ids)})" for p, ids in stores.items() if ids is not None]
        limited = ", ".join(f"'{p}'" for p, ids in stores.items() if ids is not None)
        if not parts:
            return df
        return df.where(F.expr(" OR ".join([f"`{platform_col}` NOT IN ({limited})", *parts])))
    return df.where(F.expr(_in_list(store_col, stores)))


def selection_rows(compare_rows: DataFrame, stores, platforms: Iterable[str] = ("DD", "UE")) -> DataFrame:
    """The selection itself as distinct (platform, store_id) rows, whether or not
    the stores have data; where nothing is selected, the stores of
    ``compare_rows`` (platform, store_id)."""
    spark = compare_rows.sparkSession
    schema = "platform string, store_id string"
    if stores is None:
        return compare_rows.select("platform", "store_id").distinct()
    if isinstance(stores, DataFrame):
        ids = stores.select(F.col(f"`{stores.columns[-1]}`").cast("string").alias("store_id"),
                            (F.array(F.col(f"`{stores.columns[0]}`").cast("string")) if len(stores.columns) == 2
                             else F.array(*map(F.lit, platforms))).alias("p"))
        return ids.where("store_id IS NOT NULL AND store_id <> ''").select(F.explode("p").alias("platform"), "store_id").distinct()
    by = stores if isinstance(stores, dict) else dict.fromkeys(platforms, stores)
    listed = spark.createDataFrame(sorted({(p, str(i)) for p, ids in by.items() if ids is not None for i in ids}), schema)
    open_ = [p for p in platforms if by.get(p) is None]
    if not open_:
        return listed
    return listed.unionByName(compare_rows.where(F.col("platform").isin(open_)).select("platform", "store_id").distinct())


def tag_periods(df: DataFrame, params: ReportParams,
                date_col: str = "event_date", periods: Iterable[str] = PERIODS) -> DataFrame:
    """Range join of rows to the windows (J7) as a ``period`` column.

    A row inside two overlapping windows comes out twice, once per period, and
    a row in none not at all.  The windows are request parameters, so each row
    explodes the array of the windows it matches; no join is needed."""
    flags = ", ".join(f"CASE WHEN {sql} THEN '{p}' END" for p, sql in window_flags_sql(params, date_col, periods).items())
    return df.withColumn("period", F.explode(F.expr(f"array_compact(array({flags}))")))
