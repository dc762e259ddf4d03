"""Time-of-day slots.

Slot bounds are data: a tuple of five cut points in minutes after midnight.
A minute ``m`` belongs to slot ``i`` when ``cut[i-1] <= m < cut[i]``.
"""

from __future__ import annotations

# Slot names in business order.
SLOT_NAMES = ("Overnight", "Breakfast", "Lunch", "Afternoon", "Dinner", "Late night")

# Cut points (minutes after midnight) between consecutive slots.
# STANDARD is the documented table: 5:00, 11:00, 14:00, 17:00, 20:00.
STANDARD = (300, 660, 840, 1020, 1200)
# DD_AS_CODED is the table the DD slot report actually applies (G4):
# 5:00, 10:59, 13:59, 15:59, 19:19.
DD_AS_CODED = (300, 659, 839, 959, 1159)

# Default bounds per platform.
PLATFORM_BOUNDS = {"DD": DD_AS_CODED, "UE": STANDARD}


def slot_sql(minute: str, bounds: tuple[int, ...] = STANDARD) -> str:
    """Slot name of a minute of day as SQL text; a null or negative minute has none."""
    arms = " ".join(f"WHEN {minute} < {cut} THEN '{name}'" for name, cut in zip(SLOT_NAMES, bounds))
    return (f"CASE WHEN {minute} IS NULL OR {minute} < 0 THEN CAST(NULL AS STRING) {arms} "
            f"ELSE '{SLOT_NAMES[-1]}' END")


def slot_by_platform_sql(minute: str = "minute_of_day", platform: str = "platform",
                         bounds_by_platform: dict | None = None) -> str:
    b = bounds_by_platform or PLATFORM_BOUNDS
    arms = " ".join(f"WHEN {platform} = '{p}' THEN {slot_sql(minute, bounds)}" for p, bounds in b.items())
    return f"CASE {arms} ELSE {slot_sql(minute, STANDARD)} END"
