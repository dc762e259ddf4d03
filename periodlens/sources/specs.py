"""Source specifications and column resolution.

A ``SourceSpec`` says, per logical column, how to find the physical column
in an export's header: by a list of names (exact match in list order, then
case-insensitive), by ordinal position, or by substrings.  Resolution runs on
the driver over the header names only (no job) and yields one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class MissingColumn(ValueError):
    """A required logical column could not be found in a source header (C17)."""


@dataclass(frozen=True)
class Names:
    """First of ``names`` present: exact match in order, then case-insensitive."""
    names: tuple[str, ...]
    case_insensitive: bool = True

    def find(self, cols: list[str]) -> str | None:
        for n in self.names:
            if n in cols:
                return n
        if self.case_insensitive:
            low = {}
            for c in cols:
                low.setdefault(c.lower(), c)
            for n in self.names:
                if n.lower() in low:
                    return low[n.lower()]
        return None


@dataclass(frozen=True)
class Ordinal:
    """The column at a 0-based position (requires ``index + 1`` columns)."""
    index: int

    def find(self, cols: list[str]) -> str | None:
        return cols[self.index] if len(cols) > self.index else None


@dataclass(frozen=True)
class Contains:
    """First column whose lower-cased name contains every given substring."""
    parts: tuple[str, ...]

    def find(self, cols: list[str]) -> str | None:
        for c in cols:
            if all(p in c.lower() for p in self.parts):
                return c
        return None


@dataclass(frozen=True)
class FirstOf:
    rules: tuple

    def find(self, cols: list[str]) -> str | None:
        for r in self.rules:
            hit = r.find(cols)
            if hit is not None:
                return hit
        return None


@dataclass(frozen=True)
class SourceSpec:
    """How to read one export family and map it onto a canonical fact."""
    name: str
    platform: str | None
    header_line: int                     # 1 = header on the first line, 2 = one banner line first
    columns: dict = field(default_factory=dict)     # logical -> rule
    required: tuple[str, ...] = ()
    date_rule: str = "per_row"           # "per_row" (C11/C13) or "per_file" (C10/C12)

    def resolve(self, header: list[str]) -> dict[str, str | None]:
        header = [h.strip() for h in header]
        out = {k: rule.find(header) for k, rule in self.columns.items()}
        missing = [k for k in self.required if out.get(k) is None]
        if missing:
            raise MissingColumn(f"{self.name}: cannot resolve {missing} in columns {header[:10]}")
        return out


# Header names the exports use, in the priority order they are tried.
# Store tables take ``Net total`` first, the date export the historical column
# first for last-year windows (G11).  One spec serves every report of a source,
# so the DD store fallback applies to the date export too (G21); sales and
# dates are declared, never guessed from names (G12); ids stay text.
DD_DATE_NAMES = ("Timestamp local date", "Timestamp Local Date", "Timestamp Local date",
                 "timestamp local date", "Date", "date", "Timestamp", "timestamp")
DD_TIME_NAMES = ("Timestamp local time", "Timestamp Local Time", "timestamp local time",
                 "Order received local time", "Order Received Local Time")
DD_STORE_NAMES = ("Merchant store ID", "Store ID")
DD_PAYOUT_NAMES = ("Net total", "Net total (for historical reference only)")
DD_PAYOUT_HIST_NAMES = ("Net total (for historical reference only)", "Net total")
STORE_NAMES = ("Store ID", "Shop ID")
PROMOTION_SPEND = "Customer discounts from marketing | (Funded by you)"
SPONSORED_SPEND = "Marketing fees | (including any applicable taxes)"
CAMPAIGN_KEY = "Is self serve campaign"

DD_ORDERS = SourceSpec(
    name="dd_orders", platform="DD", header_line=1, date_rule="per_file",
    columns={
        "store_id": Names(DD_STORE_NAMES, case_insensitive=False),
        "order_id": Names(("DoorDash order ID",), case_insensitive=False),
        "date": Names(DD_DATE_NAMES),
        "time": Names(DD_TIME_NAMES, case_insensitive=False),
        "sales": Names(("Subtotal",), case_insensitive=False),
        "payouts": Names(DD_PAYOUT_NAMES, case_insensitive=False),
        "payouts_hist": FirstOf((Names(DD_PAYOUT_HIST_NAMES), Contains(("net total",)))),
    },
    required=("store_id", "order_id", "date", "sales", "payouts"),
)

UE_ORDERS = SourceSpec(
    name="ue_orders", platform="UE", header_line=2, date_rule="per_row",
    columns={
        "store_id": Names(STORE_NAMES, case_insensitive=False),
        "order_id": Names(("Order ID",), case_insensitive=False),
        "date": Ordinal(8),
        "time": FirstOf((Ordinal(9), Contains(("accept", "time")))),
        "sales": Names(("Sales (excl. tax)",), case_insensitive=False),
        "payouts": Names(("Total payout",), case_insensitive=False),
        "payouts_hist": Names(("Total payout",), case_insensitive=False),
    },
    required=("store_id", "order_id", "date", "sales", "payouts"),
)

PROMOTION = SourceSpec(
    name="promotion", platform=None, header_line=1, date_rule="per_file",
    columns={
        "date": Names(("Date",), case_insensitive=False),
        "store_id": Names(STORE_NAMES, case_insensitive=False),
        "campaign_key": Names((CAMPAIGN_KEY,), case_insensitive=False),
        "orders": Names(("Orders",), case_insensitive=False),
        "sales": Names(("Sales",), case_insensitive=False),
        "spend": Names((PROMOTION_SPEND,), case_insensitive=False),
        "new_customers": Contains(("new customers acquired",)),
    },
    required=("date", "campaign_key", "orders", "sales", "spend"),
)

SPONSORED = SourceSpec(
    name="sponsored", platform=None, header_line=1, date_rule="per_row",
    columns={
        "date": Names(("Date",), case_insensitive=False),
        "store_id": Names(STORE_NAMES, case_insensitive=False),
        "campaign_key": Names((CAMPAIGN_KEY,), case_insensitive=False),
        "orders": Names(("Orders",), case_insensitive=False),
        "sales": Names(("Sales",), case_insensitive=False),
        "spend": Names((SPONSORED_SPEND,), case_insensitive=False),
        "new_customers": Contains(("new customers acquired",)),
    },
    required=("date", "campaign_key", "orders", "sales", "spend"),
)

LEGACY_DD_MARKETING = SourceSpec(
    name="legacy_dd_marketing", platform="DD", header_line=1, date_rule="per_file",
    columns={"date": Names(("Date",), case_insensitive=False),
             "store_id": Names(STORE_NAMES, case_insensitive=False),
             "new_customers": Names(("New customers acquired",), case_insensitive=False)},
    required=("store_id", "new_customers"),
)

LEGACY_UE_MARKETING = SourceSpec(
    name="legacy_ue_marketing", platform="UE", header_line=1,
    columns={"new_customers": Names(("New customers",), case_insensitive=False)},
    required=("new_customers",),
)
