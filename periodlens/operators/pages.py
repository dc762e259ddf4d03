"""Date x store report with a column for every store.

A table cannot have a column per store when there are many thousands, so the
stores are laid out on pages of a fixed number of columns: the n-th store by id
(``staging.numbered``: a dense rank that no single task computes) has place
``n % width`` on page ``n div width``.  The header map tells which store that
is.  Each page holds the page's total and the day's total over all stores, so
pages can be printed side by side or one below the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import MONEY_SUM
from ..staging import Staging, numbered
from .daily import DAILY_VALUES


def page_header(staging: Staging, cells_dec: DataFrame, width: int) -> DataFrame:
    """Page, place on it (from 0) and store id, for every store that has a cell."""
    stores = cells_dec.where("store_id IS NOT NULL").select("store_id").distinct()
    ranked = numbered(staging, stores, ["store_id"])
    return staging.put(ranked.selectExpr(f"CAST(rank div {width} AS INT) AS page", f"CAST(rank % {width} AS INT) AS place", "store_id"), "pages")


def store_pages(cells_dec: DataFrame, header: DataFrame, width: int, metrics: Sequence[str] = DAILY_VALUES) -> DataFrame:
    """Per platform, period, metric and page one row per day and a Total row (``event_date``
    null): columns ``s00`` ... by place, ``page_total`` and ``total``; missing cells are 0.

    A day that has no cell on a page has no row there.  Sums are exact until the last cast."""
    structs = ", ".join(f"named_struct('metric', '{m}', 'v', CAST(`{m}` AS {MONEY_SUM}))" for m in metrics)
    long = cells_dec.selectExpr("platform", "period", "event_date", "store_id", f"inline(array({structs}))")
    keys = ["platform", "period", "metric"]

    def total(condition: str, name: str):
        return F.expr(f"CAST(coalesce(sum(CASE WHEN {condition} THEN v END), 0) AS DOUBLE)").alias(name)

    columns = [f"s{i:02d}" for i in range(width)]
    placed = long.join(header, "store_id")
    pages = placed.groupingSets([[*keys, "page", "event_date"], [*keys, "page"]], *keys, "page", "event_date").agg(
        *[total(f"place = {i}", c) for i, c in enumerate(columns)], total("TRUE", "page_total"))
    days = long.groupingSets([[*keys, "event_date"], keys], *keys, "event_date").agg(total("TRUE", "total"))
    on = F.col("event_date").eqNullSafe(F.col("_day"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    days = days.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("event_date").alias("_day"), "total")
    return pages.join(days, on).select(*keys, "page", "event_date", *columns, "page_total", "total")
