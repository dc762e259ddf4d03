"""Report parameters and the period dimension.

A report compares four calendar windows: the user's ``pre`` and ``post``
ranges (``pre_25`` / ``post_25``) and the same ranges one calendar year
earlier (``pre_24`` / ``post_24``).  The parameters are plain driver-side
values; everything that touches data is a DataFrame expression.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four window names in the order reports list them.
PERIODS = ("pre_24", "post_24", "pre_25", "post_25")


def last_year(d: dt.date) -> dt.date:
    """The same calendar day one year back; Feb 29 becomes Feb 28.

    Equal to Spark's ``add_months(d, -12)``.
    """
    try:
        return d.replace(year=d.year - 1)
    except ValueError:
        return d.replace(year=d.year - 1, day=28)


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    s = str(v).strip()
    for fmt in ("%Y-%m-%d", "%m/%d/%Y"):
        try:
            return dt.datetime.strptime(s, fmt).date()
        except ValueError:
            pass
    raise ValueError(f"not a date: {v!r}")


@dataclass(frozen=True)
class ReportParams:
    """Typed report request: two ranges, excluded days, store selection.

    ``stores`` is ``None`` for "all stores", a tuple for one selection on both
    platforms, or ``{platform: tuple or None}`` for one selection per platform
    (a platform that is not named, or named with ``None``, keeps all its
    stores).  A selection that is itself data (for example derived from a
    table) is passed to the operators as a DataFrame instead.

    ``end_at_midnight`` compares raw timestamps with the end of a window at
    midnight, so rows later on the last day fall out (F1, G3); it needs facts
    with ``event_ts``.  By default windows compare calendar days.
    """

    pre_start: dt.date
    pre_end: dt.date
    post_start: dt.date
    post_end: dt.date
    excluded: tuple[dt.date, ...] = ()
    stores: tuple[str, ...] | dict | None = None
    operator: str = ""
    extra: dict = field(default_factory=dict, compare=False)
    end_at_midnight: bool = False

    @classmethod
    def of(cls, pre: tuple, post: tuple, excluded: Iterable = (), stores: Iterable | dict | None = None,
           operator: str = "", end_at_midnight: bool = False) -> "ReportParams":
        def ids(xs):
            return None if xs is None else tuple(str(s).strip() for s in xs)

        p = cls(
            _as_date(pre[0]), _as_date(pre[1]), _as_date(post[0]), _as_date(post[1]),
            tuple(sorted({_as_date(x) for x in excluded})),  # union of day lists (U4)
            {p: ids(xs) for p, xs in stores.items()} if isinstance(stores, dict) else ids(stores),
            operator, end_at_midnight=end_at_midnight,
        )
        p.validate()
        return p

    def validate(self) -> None:
        if self.pre_start > self.pre_end or self.post_start > self.post_end:
            raise ValueError("range start must not be after its end")

    @property
    def windows(self) -> dict[str, tuple[dt.date, dt.date]]:
        """period -> (start, end), both ends inclusive, in ``PERIODS`` order."""
        return {
            "pre_24": (last_year(self.pre_start), last_year(self.pre_end)),
            "post_24": (last_year(self.post_start), last_year(self.post_end)),
            "pre_25": (self.pre_start, self.pre_end),
            "post_25": (self.post_start, self.post_end),
        }

    @property
    def suggested_download(self) -> tuple[dt.date, dt.date]:
        """Dates an export must cover for this report: from last year's pre
        start to the post end (P3)."""
        return last_year(self.pre_start), self.post_end

    def span(self, periods: Iterable[str] = PERIODS) -> tuple[dt.date, dt.date]:
        """Smallest date range holding the given windows (the scan range, P3)."""
        w = self.windows
        sel = [w[p] for p in periods]
        return min(s for s, _ in sel), max(e for _, e in sel)


# ---------------------------------------------------------------- expressions
# Window predicates are built as SQL expression text: one JVM object per
# predicate instead of one per sub-expression (building a plan from many
# small Column objects costs a py4j round trip each).

def date_sql(d: dt.date) -> str:
    return f"DATE'{d.isoformat()}'"


def window_sql(params: ReportParams, period: str, date_col: str = "event_date") -> str:
    s, e = params.windows[period]
    if params.end_at_midnight and date_col == "event_date":
        return f"(event_ts BETWEEN TIMESTAMP_NTZ'{s} 00:00:00' AND TIMESTAMP_NTZ'{e} 00:00:00')"
    return f"(`{date_col}` BETWEEN {date_sql(s)} AND {date_sql(e)})"


def window_flags_sql(params: ReportParams, date_col: str = "event_date",
                     periods: Iterable[str] = PERIODS) -> dict[str, str]:
    return {p: window_sql(params, p, date_col) for p in periods}


def in_any_window(params: ReportParams, date_col: str = "event_date",
                  periods: Iterable[str] = PERIODS) -> Column:
    return F.expr(" OR ".join(window_flags_sql(params, date_col, periods).values()))


# ---------------------------------------------------------------- dimension

PERIOD_SCHEMA = T.StructType([
    T.StructField("period", T.StringType(), False),
    T.StructField("period_order", T.IntegerType(), False),
    T.StructField("start_date", T.DateType(), False),
    T.StructField("end_date", T.DateType(), False),
])


def period_dim(spark: SparkSession, params: ReportParams) -> DataFrame:
    """The 4-row period dimension (P2).  Its size is fixed at four rows."""
    rows = [(p, i, s, e) for i, (p, (s, e)) in enumerate(params.windows.items())]
    return spark.createDataFrame(rows, PERIOD_SCHEMA)
