"""Run a full report from export files: ``python -m periodlens ...``.

Example::

    python -m periodlens --dd 'exports/dd-*.csv' --ue 'exports/ue-*.csv' \\
        --marketing exports/marketing_data --pre 11/1/2025-11/30/2025 \\
        --post 12/1/2025-12/31/2025 --exclude 11/27/2025,12/25/2025 \\
        --stores 101,102 --operator alpha --out out/ --format parquet

Every report table is written under ``--out/<table>`` (partitioned by
``run_id`` and ``operator``) when all of them are there, the date export under ``--out/daily``, display
text of the summaries under ``--out/<table>_text``, rows that were rejected by file
and reason under ``--out/rejected_rows``, and the summary line is printed.  ``--dd-stores`` and ``--ue-stores`` select per platform, ``--stores``
on both.  Legacy new-customer files are named ``dd-mkt-<window>.csv`` and
``ue-mkt-<window>.csv`` in the ``--legacy`` folder, with the window written as
``pre-24``, ``post-24``, ``pre-25`` or ``post-25``.
"""

from __future__ import annotations

import argparse
import uuid

from .params import PERIODS, ReportParams
from .plans.report import ReportInputs, drop_staging, run_report, staging_path
from .session import build_session
from .sources import exports, sinks
from .sources import files as fs
from .staging import Staging


def _range(text: str) -> tuple[str, str]:
    a, b = text.split("-", 1) if text.count("/") >= 2 else text.split("..", 1)
    return a.strip(), b.strip()


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="periodlens", description=__doc__.split("\n")[0])
    ap.add_argument("--dd", action="append", default=[], help="DD order export glob (repeatable)")
    ap.add_argument("--ue", action="append", default=[], help="UE order export glob (repeatable)")
    ap.add_argument("--marketing", help="folder holding marketing_* folders or campaign files")
    ap.add_argument("--pre", required=True, help="M/D/YYYY-M/D/YYYY")
    ap.add_argument("--post", required=True, help="M/D/YYYY-M/D/YYYY")
    ap.add_argument("--exclude", default="", help="comma separated M/D/YYYY days")
    ap.add_argument("--stores", default="", help="comma separated store ids (empty = all)")
    ap.add_argument("--dd-stores", default="", help="the same for DD only")
    ap.add_argument("--ue-stores", default="", help="the same for UE only")
    ap.add_argument("--legacy", help="folder of per-window new-customer files")
    ap.add_argument("--end-at-midnight", action="store_true", help="windows end at midnight of their last day")
    ap.add_argument("--staging", default=None, help="folder shared by the cluster for the run's shared inputs")
    ap.add_argument("--operator", default="")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession
    created = SparkSession.getActiveSession() is None
    spark = build_session(a.master)

    def ids(text):
        return [s for s in text.split(",") if s.strip()] or None

    stores = ids(a.stores)
    if a.dd_stores or a.ue_stores:
        stores = {"DD": ids(a.dd_stores) or stores, "UE": ids(a.ue_stores) or stores}
    params = ReportParams.of(pre=_range(a.pre), post=_range(a.post), excluded=ids(a.exclude) or [],
                             stores=stores, operator=a.operator, end_at_midnight=a.end_at_midnight)
    dd = [p for g in a.dd for p in fs.glob(spark, g)]
    ue = [p for g in a.ue for p in fs.glob(spark, g)]
    run_id = uuid.uuid4().hex[:12]
    staging = Staging(spark, staging_path(spark, run_id, a.staging))
    orders = exports.all_order_rows(spark, dd, ue, staging)
    rejected, campaigns = exports.rejects(orders), None
    if a.marketing:
        root = exports.marketing_root(spark, a.marketing) or a.marketing
        rows = [exports.marketing_rows(spark, root, kind, staging=staging) for kind in exports.KINDS]
        campaigns = rows[0].unionByName(rows[1])
        rejected, campaigns = rejected.unionByName(exports.rejects(campaigns)), campaigns.drop("reject_reason")
    legacy = {}
    if a.legacy:
        for side in ("dd", "ue"):
            named = {p: fs.glob(spark, f"{a.legacy.rstrip('/')}/{side}-mkt-{p.replace('_', '-')}.csv") for p in PERIODS}
            legacy[side] = {p: found[0] for p, found in named.items() if found}
    inputs = ReportInputs(
        orders=exports.facts_of(orders), campaigns=campaigns, rejects=rejected,
        dd_new_customers=exports.legacy_dd_new_customers(spark, legacy["dd"], params.excluded, staging) if legacy.get("dd") else None,
        ue_new_customers=exports.legacy_ue_new_customer_totals(spark, legacy["ue"], staging) if legacy.get("ue") else None)
    tables = run_report(spark, params, inputs, run_id=run_id, staging=a.staging)
    line = tables["summary_line"].collect()
    sinks.write_run(spark, {**tables, **sinks.display_tables(tables), "daily": sinks.daily_long(tables["daily_cells"])}, a.out, run_id,
                    a.operator, a.format, {"daily": ("platform", "metric", "period")})
    drop_staging(spark, run_id, a.staging)
    for r in line:
        print(r.summary)
    print(f"run_id={run_id} out={a.out}")
    if created:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
