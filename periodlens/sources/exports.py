"""CSV export scans (S1-S11) and cleaning (C1-C20) into the canonical facts.

Each export is read once, as text cells by position, and staged as Parquet
(``land``): no schema inference, and no file is opened by the driver.  What the
files' headers say is found in the staged rows: the header of a file is its
first (or second) line, the files' headers are a grouped aggregate, and only the
distinct headers (one per layout) reach the driver, which resolves them against
the ``SourceSpec``.  All layouts are then projected in one pass: the cell of a
logical column is chosen by the layout of the row's file.  Cleaning is column
expressions: missing-value tokens, guarded decimal casts and the two date rules
(per row, or one format per file, voted over staged candidates).

Rows that cannot become facts keep a ``reject_reason``; ``rejects`` counts them
by file and reason.

Canonical outputs::

    order_fact    platform, store_id, order_id, event_ts, event_date, minute_of_day,
                  sales, payouts, payouts_hist, _src_file
    campaign_fact channel, store_id, campaign_key, event_date, nc_date,
                  orders, sales, spend, new_customers, _src_file

Files should be splittable (no quoted line breaks), and the first split of a file
must hold its header lines; at scale, land them once as Parquet
(``streaming.landing``) so date filters prune files.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_candidates, date_of_file, date_of_row, with_minute_of_day
from ..functions.numeric import MONEY, na_to_null, safe_decimal
from ..staging import Staging
from . import files as fs
from .specs import (DD_ORDERS, LEGACY_DD_MARKETING, LEGACY_UE_MARKETING, PROMOTION, SPONSORED,
                    UE_ORDERS, SourceSpec)

FILE_COL = "_src_file"
# Columns that a scan expects at most; a family with a wider header is read again with twice as many.
WIDTH = 64


def _unique(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        n = n.strip()
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


@dataclass
class Landed:
    """Staged cells of a family of files (``c0`` ... by position) and the distinct headers."""
    rows: DataFrame                      # data rows: cells, file, layout number
    files: DataFrame                     # file, layout number
    headers: list[list[str]]             # by layout number


def raw_cells(spark: SparkSession, paths: Sequence[str], width: int = WIDTH) -> DataFrame:
    """All lines of the files as text cells, with the file, where the line's split starts,
    and a number that grows along each split.

    The schema has one column more than is read: a pruned scan fills short lines with
    nulls, a whole one raises (and catches) an error for each."""
    schema = ", ".join(f"c{i} string" for i in range(width + 2))
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(list(paths)).select(
        *[f"c{i}" for i in range(width + 1)], F.col("_metadata.file_path").alias(FILE_COL), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))


def land(spark: SparkSession, paths: Iterable[str], header_line: int, staging: Staging | None = None,
         width: int = WIDTH, first_per_folder: bool = False) -> Landed | None:
    """Stages the files and finds their headers; None if there is nothing to read.

    ``first_per_folder`` keeps, of each folder, the file whose path sorts first (S5)."""
    paths = sorted(set(paths))
    if not paths:
        return None
    staging = staging or Staging(spark)
    raw = staging.put(raw_cells(spark, paths, width), "cells")
    top = raw.where("_block = 0")
    firsts = top.groupBy(FILE_COL).agg(F.min("_line").alias("_first"))
    if first_per_folder:
        firsts = firsts.join(first_of_folder(firsts), FILE_COL, "left_semi")
    firsts = firsts.select(F.col(FILE_COL).alias("_file"), (F.col("_first") + (header_line - 1)).alias("_head"))
    at_head = (F.col(FILE_COL) == F.col("_file")) & (F.col("_line") == F.col("_head"))
    cells = ", ".join(f"coalesce(c{i}, '')" for i in range(width + 1))
    # Tables with a row per file are broadcast by name: the planner takes a join's size for the product of its
    # sides, and staged cells of few distinct values for small, so it would broadcast the cells.
    heads = staging.put(top.join(F.broadcast(firsts), at_head).selectExpr("_file", "_head", f"array({cells}) AS header"), "heads")
    found = sorted(tuple(r.header) for r in heads.select("header").distinct().collect())
    headers = []
    if any(cell[width].strip() for cell in found):
        return land(spark, paths, header_line, staging, 2 * width, first_per_folder)
    for cell in found:
        names = [c.lstrip("\ufeff").strip() for c in cell]
        while names and not names[-1]:
            names.pop()
        headers.append(_unique(names))
    if not headers:
        return None
    numbers = spark.createDataFrame([(list(c), i) for i, c in enumerate(found)], "header array<string>, layout int")
    files = heads.join(F.broadcast(numbers), "header").select("_file", "_head", "layout")
    rows = raw.join(F.broadcast(files), (F.col(FILE_COL) == F.col("_file")) & ((F.col("_block") > 0) | (F.col("_line") > F.col("_head"))))
    return Landed(rows.drop("_file", "_head", "_block", "_line"), files.select(F.col("_file").alias(FILE_COL), "layout"), headers)


def first_of_folder(files: DataFrame) -> DataFrame:
    """Of the files (``_src_file``), the first of each folder by path."""
    folder = F.regexp_replace(FILE_COL, "/[^/]*$", "")
    return files.groupBy(folder.alias("_folder")).agg(F.min(FILE_COL).alias(FILE_COL)).select(FILE_COL)


def layouts(spark: SparkSession, paths: Iterable[str], header_line: int) -> list[list[str]]:
    """The distinct headers of the files.  A banner line above the header plays no part."""
    landed = land(spark, paths, header_line)
    return landed.headers if landed else []


def _by_layout(values: Sequence, otherwise: str, of=str) -> str:
    """SQL that picks a value by the row's layout number; equal values share a branch."""
    by: dict = {}
    for i, v in enumerate(values):
        by.setdefault(v, []).append(i)
    sql = [f"WHEN layout IN ({', '.join(map(str, at))}) THEN {of(v)}" for v, at in by.items() if v is not None]
    return f"CASE {' '.join(sql)} ELSE {otherwise} END" if sql else otherwise


def scan(spark: SparkSession, paths: Iterable[str], spec: SourceSpec, staging: Staging | None = None,
         first_per_folder: bool = False) -> DataFrame | None:
    """The files' rows as logical text columns of ``spec`` (missing-value tokens are null,
    C15), with ``_has_date`` (the file's layout has a date column) and the file.

    Every layout is resolved by itself, so header variants across files each
    resolve (G10); all are projected in one pass (U1)."""
    landed = land(spark, paths, spec.header_line, staging, first_per_folder=first_per_folder)
    if landed is None:
        return None
    resolved = [spec.resolve(h) for h in landed.headers]

    def cell(key: str) -> str:
        return _by_layout([None if r[key] is None else h.index(r[key]) for h, r in zip(landed.headers, resolved)],
                          "CAST(NULL AS STRING)", lambda i: f"c{i}")

    has_date = _by_layout([r.get("date") is not None for r in resolved], "false", lambda v: str(v).lower())
    return landed.rows.select(*[na_to_null(F.expr(cell(k))).alias(k) for k in spec.columns],
                              F.expr(has_date).alias("_has_date"), FILE_COL)


def _dated(df: DataFrame, spec: SourceSpec, staging: Staging, out: str = "event_date") -> DataFrame:
    """Typed rows with ``out``: candidates are parsed once and staged; for the per-file rule
    the files vote over the staged columns."""
    df = staging.put(date_candidates(df, "_date_text"), "typed")
    return date_of_file(df, out, FILE_COL) if spec.date_rule == "per_file" else df.withColumn(out, date_of_row())


# Why a row is not a fact, in the order in which the reasons are tried.
NO_DATE, UNREADABLE_DATE, OTHER_FORMAT, NO_STORE = "no date", "unreadable date", "date format differs from its file", "no store"


def _reason(store: bool = True) -> Column:
    none = "WHEN store_id IS NULL OR store_id = '' THEN '%s'" % NO_STORE if store else ""
    return F.expr(f"""CASE WHEN _date_text IS NULL OR trim(_date_text) = '' THEN '{NO_DATE}'
        WHEN event_date IS NULL AND coalesce(_us, _iso, to_date(_ts)) IS NOT NULL THEN '{OTHER_FORMAT}'
        WHEN event_date IS NULL THEN '{UNREADABLE_DATE}' {none} END""")


def rejects(rows: DataFrame) -> DataFrame:
    """Rejected rows by file and reason, from ``order_rows`` or ``campaign_rows``."""
    return rows.where("reject_reason IS NOT NULL").groupBy(FILE_COL, "reject_reason").agg(F.count(F.lit(1)).alias("rows"))


REJECT_SCHEMA = f"{FILE_COL} string, reject_reason string, rows bigint"


# ---------------------------------------------------------------- order exports

ORDER_SCHEMA = ("platform string, store_id string, order_id string, event_ts timestamp_ntz, event_date date, "
                f"minute_of_day int, sales {MONEY}, payouts {MONEY}, payouts_hist {MONEY}, "
                f"{FILE_COL} string")


def order_rows(spark: SparkSession, paths: Iterable[str], spec: SourceSpec, staging: Staging | None = None) -> DataFrame:
    """Every row of an order export in the types of the fact, with
    ``reject_reason`` (null for rows that are facts)."""
    staging = staging or Staging(spark)
    df = scan(spark, paths, spec, staging)
    if df is None:
        return spark.createDataFrame([], ORDER_SCHEMA + ", reject_reason string")
    typed = df.select(
        F.lit(spec.platform).alias("platform"), F.trim("store_id").alias("store_id"), F.trim("order_id").alias("order_id"),
        F.col("date").alias("_date_text"), "time",
        *[safe_decimal(c).alias(c) for c in ("sales", "payouts", "payouts_hist")], FILE_COL)
    dated = _dated(with_minute_of_day(typed, "time", "minute_of_day").drop("time"), spec, staging)
    # the raw timestamp of the date column: midnight unless its text has a time
    return dated.select("platform", "store_id", "order_id", F.expr("CASE WHEN event_date IS NOT NULL THEN coalesce(_ts, CAST(event_date AS TIMESTAMP_NTZ)) END").alias("event_ts"),
                        "event_date", "minute_of_day", "sales", "payouts", "payouts_hist", FILE_COL, _reason().alias("reject_reason"))


def facts_of(rows: DataFrame, observation=None) -> DataFrame:
    """The rows without a reason against them (C14)."""
    if observation is not None:
        # How many rows were read and how many had no usable date or store
        rows = rows.observe(observation, F.count(F.lit(1)).alias("rows_read"),
                            F.count(F.when(F.col("event_date").isNull(), 1)).alias("rows_without_date"),
                            F.count(F.when(F.col("store_id").isNull() | (F.col("store_id") == ""), 1))
                            .alias("rows_without_store"))
    return rows.where("reject_reason IS NULL").drop("reject_reason")


def order_fact(spark: SparkSession, paths: Iterable[str], spec: SourceSpec,
               observation=None, staging: Staging | None = None) -> DataFrame:
    """An order export -> ``order_fact`` (rows without a parsable
    date or a store are dropped, C14; ``order_rows`` and ``rejects`` tell which).
    Pass a ``pyspark.sql.Observation`` to learn how many rows were dropped once
    the result has been computed."""
    return facts_of(order_rows(spark, paths, spec, staging), observation)


def _with_period(rows: DataFrame, files_by_period: dict[str, str]) -> DataFrame:
    """Rows with the window that their file stands for."""
    spark, same = rows.sparkSession, r"^([A-Za-z0-9+.-]+:)/+"
    names = spark.createDataFrame([(period, fs.qualified(spark, path)) for period, path in files_by_period.items()], "period string, _name string")
    on = F.regexp_replace(FILE_COL, same, "$1/") == F.regexp_replace("_name", same, "$1/")
    return rows.join(F.broadcast(names), on).drop("_name")


def orders_by_period_files(spark: SparkSession, files_by_period: dict[str, str],
                           spec: SourceSpec, staging: Staging | None = None) -> DataFrame:
    """One export file per window; the window is taken from the file
    (``period`` column) rather than from the date."""
    return _with_period(order_fact(spark, files_by_period.values(), spec, staging=staging), files_by_period)


def dd_orders(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return order_fact(spark, paths, DD_ORDERS)


def ue_orders(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return order_fact(spark, paths, UE_ORDERS)


def orders(spark: SparkSession, dd_paths: Iterable[str] = (), ue_paths: Iterable[str] = (), staging: Staging | None = None) -> DataFrame:
    """Both platforms on one fact (explicit specs, no file-name sniffing, G13)."""
    return facts_of(all_order_rows(spark, dd_paths, ue_paths, staging))


def all_order_rows(spark: SparkSession, dd_paths: Iterable[str] = (), ue_paths: Iterable[str] = (), staging: Staging | None = None) -> DataFrame:
    """Rows of both platforms, facts and rejected ones."""
    return order_rows(spark, dd_paths, DD_ORDERS, staging).unionByName(order_rows(spark, ue_paths, UE_ORDERS, staging))


# ---------------------------------------------------------------- marketing exports

CAMPAIGN_SCHEMA = ("channel string, store_id string, campaign_key string, event_date date, "
                   f"nc_date date, orders {MONEY}, sales {MONEY}, spend {MONEY}, "
                   f"new_customers {MONEY}, undated boolean, {FILE_COL} string")


def campaign_rows(spark: SparkSession, paths: Iterable[str], spec: SourceSpec, channel: str, undated: str = "error",
                  staging: Staging | None = None, first_per_folder: bool = False) -> DataFrame:
    """Every row of promotion or sponsored files, with ``reject_reason``.

    ``event_date`` follows the campaign-table rule (per row, C13) and
    ``nc_date`` the new-customer rule (one format per file, C12).  Missing
    metric values are 0 (C18); a missing new-customer value stays null.

    A file without a ``Date`` column is an error by default; with
    ``undated="keep"`` its rows are kept with ``undated = true`` and the
    campaign tables count them whatever the window (F6 parity).

    A row whose date is unreadable counts in no window; its reason says so, but
    it stays in ``campaign_fact``, whose consumers filter by window.
    """
    if undated == "keep":
        from dataclasses import replace
        spec = replace(spec, required=tuple(r for r in spec.required if r != "date"))
    staging = staging or Staging(spark)
    df = scan(spark, paths, spec, staging, first_per_folder)
    if df is None:
        return spark.createDataFrame([], CAMPAIGN_SCHEMA + ", reject_reason string")
    typed = df.select(
        F.lit(channel).alias("channel"), (~F.col("_has_date")).alias("undated"), F.trim("store_id").alias("store_id"), "campaign_key",
        F.col("date").alias("_date_text"), *[F.coalesce(safe_decimal(c), F.lit(0).cast(MONEY)).alias(c) for c in ("orders", "sales", "spend")],
        safe_decimal("new_customers").alias("new_customers"), FILE_COL)
    dated = date_of_file(staging.put(date_candidates(typed, "_date_text"), "typed"), "nc_date", FILE_COL).withColumn("event_date", date_of_row())
    return dated.select("channel", "store_id", "campaign_key", "event_date", "nc_date", "orders", "sales", "spend", "new_customers",
                        "undated", FILE_COL, F.when(~F.col("undated"), _reason(store=False)).alias("reject_reason"))


def campaign_fact(spark: SparkSession, paths: Iterable[str], spec: SourceSpec, channel: str, undated: str = "error",
                  staging: Staging | None = None, first_per_folder: bool = False) -> DataFrame:
    """Promotion or sponsored files -> ``campaign_fact`` (see ``campaign_rows``)."""
    return campaign_rows(spark, paths, spec, channel, undated, staging, first_per_folder).drop("reject_reason")


def marketing_root(spark: SparkSession, base: str) -> str | None:
    """``base`` if it holds ``marketing_*`` folders, else the first child that does."""
    base = base.rstrip("/")
    if fs.dirs(spark, f"{base}/marketing_*"):
        return base
    for child in fs.dirs(spark, f"{base}/*"):
        if fs.dirs(spark, f"{child}/marketing_*"):
            return child
    return None


def marketing_files(spark: SparkSession, root: str, kind: str = "PROMOTION",
                    first_per_folder: bool = False) -> list[str]:
    """``MARKETING_<kind>*.csv`` in the root itself, in its
    ``marketing_*`` folders, and (when the root is itself a ``marketing_*``
    folder) directly inside it; each path once (G9).  ``first_per_folder``
    keeps only the first file per folder (the campaign tables' behaviour);
    by default every file is read (G17)."""
    root = root.rstrip("/")
    found = set(fs.glob(spark, f"{root}/MARKETING_{kind}*.csv"))
    found |= set(fs.glob(spark, f"{root}/marketing_*/MARKETING_{kind}*.csv"))
    paths = sorted(found)
    if first_per_folder:
        first: dict[str, str] = {}
        for p in paths:
            first.setdefault(p.rsplit("/", 1)[0], p)
        paths = sorted(first.values())
    return paths


# Spec and channel of each kind of campaign file.
KINDS = {"PROMOTION": (PROMOTION, "promotion"), "SPONSORED_LISTING": (SPONSORED, "sponsored")}


def marketing_rows(spark: SparkSession, root: str, kind: str, first_per_folder: bool = False, undated: str = "error",
                   staging: Staging | None = None) -> DataFrame:
    """The campaign rows of one kind below ``root``.  Which file is a folder's first is
    found in the scan (``first_of_folder``), not from a listing on the driver."""
    spec, channel = KINDS[kind]
    return campaign_rows(spark, marketing_files(spark, root, kind), spec, channel, undated, staging, first_per_folder)


def uploaded_rows(spark: SparkSession, folder: str, kind: str = "PROMOTION", undated: str = "error",
                  staging: Staging | None = None) -> DataFrame:
    """The campaign rows of uploaded files of one kind, wherever below ``folder`` they lie,
    with the group that each file's name gives (``upload_group``).  Files are not moved."""
    spec, channel = KINDS[kind]
    names = fs.uploads(spark, folder).where(F.substring_index("path", "/", -1).startswith(f"MARKETING_{kind}"))
    paths = [r.path for r in names.select("path").collect()]  # a listing, as for any scan
    return campaign_rows(spark, paths, spec, channel, undated, staging).withColumn("upload_group", fs.upload_group(FILE_COL))


def promotions(spark: SparkSession, root: str, first_per_folder: bool = False,
               undated: str = "error", staging: Staging | None = None) -> DataFrame:
    return marketing_rows(spark, root, "PROMOTION", first_per_folder, undated, staging).drop("reject_reason")


def sponsored(spark: SparkSession, root: str, first_per_folder: bool = False,
              undated: str = "error", staging: Staging | None = None) -> DataFrame:
    return marketing_rows(spark, root, "SPONSORED_LISTING", first_per_folder, undated, staging).drop("reject_reason")


# ---------------------------------------------------------------- legacy per-period files

def legacy_dd_new_customers(spark: SparkSession, files_by_period: dict[str, str],
                            excluded: Iterable = (), staging: Staging | None = None) -> DataFrame:
    """One DD marketing file per window; the window comes from the file,
    not the date; only excluded days are removed.  -> period, store_id,
    new_customers."""
    from ..operators.facts import exclude_days
    staging = staging or Staging(spark)
    df = scan(spark, files_by_period.values(), LEGACY_DD_MARKETING, staging)
    if df is None:
        return spark.createDataFrame([], f"period string, store_id string, new_customers {MONEY}")
    df = _with_period(df, files_by_period)
    typed = df.select("period", F.trim("store_id").alias("store_id"), F.col("date").alias("_date_text"),
                      safe_decimal("new_customers").alias("new_customers"), FILE_COL)
    days = list(excluded)
    if days:
        typed = exclude_days(_dated(typed, LEGACY_DD_MARKETING, staging), days)
    return (typed.where(F.col("store_id").isNotNull() & F.col("new_customers").isNotNull())
            .select("period", "store_id", "new_customers"))


def legacy_ue_new_customer_totals(spark: SparkSession, files_by_period: dict[str, str], staging: Staging | None = None) -> DataFrame:
    """Platform-level new customers per window from one file each (no
    date filter).  -> period, new_customers."""
    df = scan(spark, files_by_period.values(), LEGACY_UE_MARKETING, staging)
    if df is None:
        return spark.createDataFrame([], f"period string, new_customers {MONEY}")
    return _with_period(df, files_by_period).groupBy("period").agg(F.coalesce(F.sum(safe_decimal("new_customers")), F.lit(0)).alias("new_customers"))


# ---------------------------------------------------------------- profile

def profile_rows(df: DataFrame, keys: list[str], header: Iterable[str], date: Column | None) -> DataFrame:
    """S10 of one layout: rows, first and last date per key, the first ten
    column names and whether a date column was found."""
    d = date if date is not None else F.lit(None).cast("date")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(d).alias("start_date"), F.max(d).alias("end_date")).withColumn(
        "columns", F.lit(", ".join(list(header)[:10]))).withColumn("date_column_found", F.lit(date is not None))


def profile(spark: SparkSession, paths: Iterable[str], spec: SourceSpec, staging: Staging | None = None) -> DataFrame:
    """Per file: rows, first and last parsed date, the first ten column
    names and whether a date column was found."""
    landed = land(spark, paths, spec.header_line, staging)
    if landed is None:
        return spark.createDataFrame([], f"{FILE_COL} string, rows bigint, start_date date, "
                                         "end_date date, columns string, date_column_found boolean")
    rule = spec.columns.get("date")
    dates = [rule.find(h) if rule is not None else None for h in landed.headers]
    text = _by_layout([None if d is None else h.index(d) for h, d in zip(landed.headers, dates)], "CAST(NULL AS STRING)", lambda i: f"c{i}")
    texts = landed.rows.select(F.col(FILE_COL).alias("_file"), na_to_null(F.expr(text)).alias("_text"))
    counted = date_candidates(texts, "_text").withColumn("_d", date_of_row()).groupBy("_file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_d").alias("start_date"), F.max("_d").alias("end_date"))
    names = spark.createDataFrame([(i, ", ".join(h[:10]), x is not None) for i, (h, x) in enumerate(zip(landed.headers, dates))],
                                  "layout int, columns string, date_column_found boolean")
    files = landed.files.join(names, "layout").join(counted, F.col(FILE_COL) == F.col("_file"), "left")
    return files.select(FILE_COL, F.coalesce("rows", F.lit(0)).alias("rows"), "start_date", "end_date", "columns", "date_column_found")


__all__ = ["order_fact", "order_rows", "all_order_rows", "facts_of", "rejects", "orders_by_period_files", "dd_orders", "ue_orders", "orders",
           "campaign_fact", "campaign_rows", "marketing_rows", "uploaded_rows", "promotions", "sponsored", "marketing_root", "marketing_files", "first_of_folder",
           "legacy_dd_new_customers", "legacy_ue_new_customer_totals", "profile", "profile_rows", "layouts", "land", "raw_cells", "scan"]
