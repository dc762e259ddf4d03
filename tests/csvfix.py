"""Writers for small messy CSV exports (invented values, FIXTURES.md layouts)."""

import csv
import os

DD_HEADER = [" Timestamp local date ", "Timestamp local time", " Merchant store ID ", "DoorDash order ID",
             "Subtotal", "Net total", "Net total (for historical reference only)"]
UE_BANNER = ["Payout report export"]
UE_HEADER = ["Store ID", "Store Name", "Order ID", "Workflow ID", "Dining Mode", "Payment Mode",
             "Order Channel", "Order Status", "Order Date", "Order Accept Time", "Sales (excl. tax)",
             "Total payout"]


def write_csv(path, rows, header=None, banner=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        if banner is not None:
            w.writerow(banner)
        if header is not None:
            w.writerow(header)
        for r in rows:
            w.writerow(r)
    return path


def dd_file(d, rows, name="dd-data.csv", header=DD_HEADER):
    return write_csv(os.path.join(d, name), rows, header)


def ue_file(d, rows, name="ue-data.csv"):
    return write_csv(os.path.join(d, name), rows, UE_HEADER, UE_BANNER)


def ue_row(store, order, date, time, sales, payout):
    return [store, "Shop", order, "w", "Delivery", "Card", "App", "Completed", date, time, sales, payout]


PROMO_HEADER = ["Date", "Store ID", "Is self serve campaign", "Orders", "Sales",
                "Customer discounts from marketing | (Funded by you)", "New customers acquired (90d)"]
SPONSORED_HEADER = ["Date", "Store ID", "Is self serve campaign", "Orders", "Sales",
                    "Marketing fees | (including any applicable taxes)"]
