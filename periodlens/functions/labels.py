"""Labels and display formatting.

Formatting is a projection applied at the very end; the numeric columns are
rounded half-to-even first so the text agrees with the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_

# Campaign type labels.
CORPORATE = "Corporate"
TODC = "TODC"
# Mover directions.
GAIN, LOSS, NO_CHANGE = "Gain", "Loss", "No Change"
# Platform display names, and the mover sources in priority order.
PLATFORM_NAMES = {"DD": "DoorDash", "UE": "UberEats"}
MOVER_SOURCES = ("Combined", "DoorDash", "UberEats")
# Row labels of the summary metrics table, in display order.
SUMMARY_METRIC_ROWS = (
    "Active Stores", "Pre Period", "Post Period", "Sales Growth (Pre→Post)", "Sales Growth (YoY)",
    "Order Growth", "New Customer Growth", "Payout Lift per Store", "Average Markup",
    "Pre TODC Growth YoY",
)


def pct_text(c) -> Column:
    """``12.3%`` from an already rounded number (M9)."""
    return F.concat(F.format_string("%.1f", F.bround(col_(c), 1)), F.lit("%"))


def money_text(c, decimals: int = 1) -> Column:
    """``$1,234.5`` (K4)."""
    x = F.bround(col_(c), decimals)
    return F.concat(F.when(x < 0, F.lit("-$")).otherwise(F.lit("$")),
                    F.format_number(F.abs(x), decimals))


def number_text(c, decimals: int = 1) -> Column:
    return F.format_number(F.bround(col_(c), decimals), decimals)


def int_text(c) -> Column:
    return F.format_number(F.bround(col_(c), 0), 0)
