"""Numeric column expressions: safe casts, guarded division, rounding.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen.  Spark 4 runs with ANSI mode on, so every division and
every cast from text is guarded here rather than left to fail at runtime.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money in the fact tables.  Sums widen to DECIMAL(28,4), which stays exact.
MONEY = "decimal(18,4)"
MONEY_SUM = "decimal(28,4)"

# Text the reader treats as missing in every column
# (the default missing-value tokens of the CSV reader the exports were
# produced for).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# A plain decimal number: optional sign, digits, optional fraction, optional
# exponent.  Thousands separators, suffixes such as ``1.5d`` and the words
# NaN / Infinity are not numbers.
_NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """Missing-value tokens become null."""
    c = col_(c)
    return F.when(F.trim(c).isin(*NA_TOKENS), F.lit(None)).otherwise(c)


def safe_decimal(c, dtype: str = MONEY) -> Column:
    """Text -> decimal; anything that is not a plain number becomes null."""
    t = F.trim(col_(c).cast("string"))
    return F.when(t.rlike(_NUMERIC_RE), t.try_cast(dtype))


def zero_if_null(c, dtype: str | None = None) -> Column:
    """``fillna(0)`` on a metric."""
    out = F.coalesce(col_(c), F.lit(0))
    return out.cast(dtype) if dtype else out


def to_double(c) -> Column:
    return col_(c).cast("double")


# Three zero-denominator rules exist, one per level (G1): this one, and as SQL
# text those of ``operators.compare`` and ``operators.summary``.

def pct_or_zero(delta, den) -> Column:
    """Summary-level percentage: zero when the denominator is zero (M3, M4)."""
    den = col_(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(to_double(delta) / to_double(den) * F.lit(100.0))
