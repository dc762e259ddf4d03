"""Date and time-of-day parsing.

Exports carry dates as text.  Two parsing rules exist:

* per row (UE exports, campaign tables): try ``M/d/yyyy`` first, then ISO,
  then the generic timestamp parser;
* per file (DD exports, promotion files): one format for the whole file,
  the first of ``M/d/yyyy`` / ISO / generic that parses *any* row of that
  file.  Rows of that file in another format are dropped.

The candidates of all formats are parsed once and staged as columns; the
per-file rule then is one small aggregate (a row per input file) over the
staged columns, joined back on the file path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted date formats, in the order they are tried.
# ``M/d/yyyy`` also accepts zero-padded ``MM/dd/yyyy``.
US_DATE = "M/d/yyyy"
ISO_DATE = "yyyy-M-d"
# A clock time, alone or behind a date: hours, minutes, seconds, AM or PM.
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([AaPp][Mm])?"
_DATE_AND_CLOCK = r"^(.*?)(?:[\sT,]+" + _CLOCK + ")?$"
# Other spellings of a date and what they are rewritten to, so
# that three formats cover all: compact and slashed ISO, month names.
_REWRITES = ((r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"), (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
             (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", "$2 $1 $3"),
             (r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})$", "$1 $2 $3"))
NAMED_DATE = "d MMM yyyy"
# What every text of a format holds.  A parser reports other text by an exception, caught
# for each row, so text that cannot be of the format does not reach it.
_HOLDS = {US_DATE: "/", ISO_DATE: "-"}
_NAMED_LIKE = r"^[^ ]+ [A-Za-z]+ [^ ]+$"

# The parsers are SQL text over a column name or SQL expression ``c``: one JVM
# object per expression, and the same text serves as one expression or step by step.


def _strip(c: str) -> str:
    return f"trim(CAST({c} AS STRING))"


def _parsed(s: str, pattern: str) -> str:
    """The date of a text without outer spaces in one format, else null."""
    like = f"contains({s}, '{_HOLDS[pattern]}')" if pattern in _HOLDS else f"{s} RLIKE r'{_NAMED_LIKE}'"
    return f"CASE WHEN {like} THEN try_to_date({s}, '{pattern}') END"


def _us(c: str) -> str:
    return _parsed(_strip(c), US_DATE)


def _iso(c: str) -> str:
    return _parsed(_strip(c), ISO_DATE)


def _clock_groups(s: str, pattern: str, group: int) -> list[str]:
    """Hours, minutes, seconds and half of the day from the clock groups of ``pattern``."""
    return [f"regexp_extract({s}, r'{pattern}', {group + i})" for i in range(4)]


def _cut(s: str, pattern: str, groups: str) -> str:
    """The text as ``groups`` of ``pattern``, behind which a last line end may stand; unchanged if the pattern
    does not match.  One match instead of one per group."""
    return f"regexp_replace({s}, r'{pattern}[\\s\\S]*', '{groups}')"


def _clock_parts(cut: str, s: str) -> list[str]:
    """Hours, minutes, seconds and half of the day from a text cut into ``h:m:sec:half``, as ``_clock_groups`` has
    them: empty if the pattern did not match.  A match has separators that the cut text has not, so they differ."""
    first = [f"substring_index({cut}, ':', {i})" for i in range(1, 5)]
    return [f"IF({cut} = {s}, '', {x})" for x in (first[0], *[f"substring_index({f}, ':', -1)" for f in first[1:]])]


def _clock_seconds(h: str, m: str, sec: str, half: str) -> str:
    """Seconds after midnight; null if the groups are no valid clock."""
    hour = (f"CASE WHEN {half} = '' THEN CAST({h} AS INT) WHEN CAST({h} AS INT) BETWEEN 1 AND 12 "
            f"THEN CAST({h} AS INT) % 12 + IF(upper({half}) = 'PM', 12, 0) END")
    return (f"CASE WHEN {h} <> '' AND CAST({m} AS INT) < 60 AND ({hour}) < 24 "
            f"THEN ({hour}) * 3600 + CAST({m} AS INT) * 60 + coalesce(CAST(nullif({sec}, '') AS INT), 0) END")


def _day_text(day: str) -> str:
    """The date part of a text, other spellings rewritten to the three formats."""
    for pattern, to in _REWRITES:
        day = f"regexp_replace({day}, r'{pattern}', '{to}')"
    return day


def _timestamp(s: str, day: str, clock: str) -> str:
    date = f"coalesce({_parsed(day, US_DATE)}, {_parsed(day, ISO_DATE)}, {_parsed(f'initcap({day})', NAMED_DATE)})"
    return (f"coalesce(CAST({date} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, coalesce({clock}, 0)), "
            f"CASE WHEN NOT {s} RLIKE r'^\\d+$' THEN try_cast({s} AS TIMESTAMP_NTZ) END)")


def _minute(alone: str, ts: str) -> str:
    return f"CAST(coalesce(floor({alone} / 60), hour({ts}) * 60 + minute({ts})) AS INT)"


def _apart(column: str) -> str:
    """The column itself, in a projection that is not fused with its neighbours.

    A lambda keeps a projection out of whole-stage code.  All parsers fused make one method of
    more than 8,000 bytes, which the JVM never compiles but interprets for every row."""
    return f"transform(array({column}), v -> v)[0] AS {column}"


def _any(c: str) -> str:
    s = _strip(c)
    return _timestamp(s, _day_text(f"regexp_extract({s}, r'{_DATE_AND_CLOCK}', 1)"), _clock_seconds(*_clock_groups(s, _DATE_AND_CLOCK, 2)))


def parse_timestamp(c: str) -> Column:
    """Date or date-time text in any accepted spelling, as a timestamp without
    zone (midnight for a date): ISO and compact dates, US dates, named months,
    each with or without a 12- or 24-hour clock time.  Other text is null."""
    return F.expr(_any(c))


def parse_date_per_row(c: str) -> Column:
    """Row-level cascade."""
    return F.expr(f"coalesce({_us(c)}, {_iso(c)}, to_date({_any(c)}))")


def with_timestamp(df: DataFrame, c: str, out: str) -> DataFrame:
    """``parse_timestamp`` as a column, step by step: each part is computed once, so the
    generated code stays small."""
    parts = ("_h", "_m", "_sec", "_half")
    df = df.selectExpr("*", f"{_strip(c)} AS _s")
    df = df.selectExpr("*", f"{_cut('_s', _DATE_AND_CLOCK, '$2:$3:$4:$5:$1')} AS _cut")
    day = "IF(_cut = _s, '', substr(_cut, length(substring_index(_cut, ':', 4)) + 2))"
    df = df.selectExpr("* EXCEPT (_cut)", f"{_day_text(day)} AS _day", *[f"{x} AS {n}" for x, n in zip(_clock_parts("_cut", "_s"), parts)])
    df = df.selectExpr("* EXCEPT (_s)", _apart("_s"), f"{_clock_seconds(*parts)} AS _clock")
    return df.selectExpr("*", f"{_timestamp('_s', '_day', '_clock')} AS {out}").drop("_s", "_clock", "_day", *parts)


def date_candidates(df: DataFrame, c: str) -> DataFrame:
    """``c`` parsed once: ``_us`` and ``_iso`` (the two exact formats) and ``_ts``
    (the generic parser's timestamp)."""
    df = df.selectExpr("*", f"{_us(c)} AS _us", f"{_iso(c)} AS _iso")
    # of text in an exact format the generic parser makes midnight of the same day: only other text goes through its patterns
    df = df.selectExpr("*", "CAST(coalesce(_us, _iso) AS TIMESTAMP_NTZ) AS _midnight", f"CASE WHEN _us IS NULL AND _iso IS NULL THEN {c} END AS _other")
    df = with_timestamp(df, "_other", "_ts")
    return df.withColumn("_ts", F.expr("coalesce(_midnight, _ts)")).drop("_midnight", "_other")


def date_of_row() -> Column:
    """The per-row cascade over staged candidates."""
    return F.expr("coalesce(_us, _iso, to_date(_ts))")


def date_of_file(df: DataFrame, out: str = "event_date", file_col: str = "_src_file") -> DataFrame:
    """File-level cascade (C10, C12) over candidates (see ``date_candidates``): each
    file votes for the first format that parses any of its rows.

    The vote reads two staged columns and has one row per file; it is broadcast by
    name, as the planner takes a grouping for about as large as its input and would
    shuffle and sort the rows by their few files."""
    vote = df.groupBy(F.col(file_col).alias("_vote_file")).agg(
        F.max(F.col("_us").isNotNull()).alias("_any_us"), F.max(F.col("_iso").isNotNull()).alias("_any_iso"))
    chosen = F.expr("CASE WHEN _any_us THEN _us WHEN _any_iso THEN _iso ELSE to_date(_ts) END")
    return (df.join(F.broadcast(vote), F.col(file_col).eqNullSafe(F.col("_vote_file")), "left")
            .withColumn(out, chosen).drop("_any_us", "_any_iso", "_vote_file"))


def minute_of_day(c: str) -> Column:
    """Minutes after midnight of a clock time (``1:11 AM``, ``1:11:05 AM``,
    ``13:11``) or of a date-time in any accepted spelling (M15)."""
    return F.expr(_minute(_clock_seconds(*_clock_groups(_strip(c), f"^{_CLOCK}$", 1)), _any(c)))


def with_minute_of_day(df: DataFrame, c: str, out: str) -> DataFrame:
    """``minute_of_day`` as a column, step by step (see ``with_timestamp``)."""
    parts = ("_h", "_m", "_sec", "_half")
    df = df.selectExpr("*", f"{_strip(c)} AS _text").selectExpr("*", f"{_cut('_text', f'^{_CLOCK}$', '$1:$2:$3:$4')} AS _cut")
    df = df.selectExpr("* EXCEPT (_cut, _text)", *[f"{x} AS {n}" for x, n in zip(_clock_parts("_cut", "_text"), parts)])
    df = df.selectExpr("* EXCEPT (_half)", _apart("_half")).selectExpr("*", f"{_clock_seconds(*parts)} AS _alone").drop(*parts)
    df = with_timestamp(df.selectExpr("*", f"CASE WHEN _alone IS NULL THEN {c} END AS _dated"), "_dated", "_minute_ts")
    return df.selectExpr("*", f"{_minute('_alone', '_minute_ts')} AS {out}").drop("_minute_ts", "_alone", "_dated")
