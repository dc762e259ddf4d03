"""The supplied tables written as export text, so that queries read them back
through the real scans (S1-S11, C1-C20).

``lineitem`` rows become lines of DD exports (no banner), UE exports (one banner
line) and campaign files, with what exports of real systems hold: two orders of
columns, date formats that differ by file and within a file, clock times in
several spellings, missing-value tokens, thousands separators, stray spaces and
quoted cells.  One file per year and half-year of the ship date; a file is
written by one task and read by as many as its size asks for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Staging
from . import files as fs
from . import testviews as tv
from .specs import CAMPAIGN_KEY, PROMOTION_SPEND, SPONSORED_SPEND

# SQL of the exports' values.  Fixed values: which rows carry which spelling.
_DAY = "CAST(l_shipdate AS DATE)"
_MINUTE = "CAST((l_orderkey * 37 + l_linenumber * 61) % 1440 AS INT)"
_CLOCK = f"make_dt_interval(0, 0, {_MINUTE}, 0) + TIMESTAMP_NTZ'2000-01-01 00:00:00'"
_US, _ISO, _NAMED = (f"date_format({_DAY}, '{p}')" for p in ("M/d/yyyy", "yyyy-MM-dd", "MMM d, yyyy"))
# the format of a file goes by its year; one row in forty has another one
_OWN_DATE = f"CASE year({_DAY}) % 3 WHEN 0 THEN IF(l_partkey % 40 = 0, {_ISO}, {_US}) WHEN 1 THEN IF(l_partkey % 40 = 0, {_NAMED}, {_ISO}) ELSE {_NAMED} END"
_BAD_DATE = "CASE WHEN l_partkey % 41 = 0 THEN 'soon' WHEN l_partkey % 43 = 0 THEN 'N/A' ELSE {} END"
DD_DATE = _BAD_DATE.format(_OWN_DATE)
UE_DATE = _BAD_DATE.format(f"CASE l_partkey % 3 WHEN 0 THEN {_US} WHEN 1 THEN {_ISO} ELSE {_NAMED} END")
TIME = (f"CASE WHEN l_partkey % 23 = 0 THEN '25:61' WHEN l_partkey % 29 = 0 THEN 'None' WHEN l_linenumber % 4 = 0 THEN date_format({_CLOCK}, 'h:mm a') "
        f"WHEN l_linenumber % 4 = 1 THEN date_format({_CLOCK}, 'HH:mm') WHEN l_linenumber % 4 = 2 THEN date_format({_CLOCK}, 'h:mm:ss a') "
        f"ELSE concat(date_format({_DAY}, 'M/d/yyyy'), ' ', date_format({_CLOCK}, 'h:mm a')) END")
STORE = "CASE WHEN l_partkey % 47 = 0 THEN element_at(array('', 'N/A', ' null ', 'nan'), CAST(l_linenumber % 4 + 1 AS INT)) ELSE concat(' ', CAST(l_suppkey AS STRING)) END"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,4))"
_PAID = f"CAST({_PRICE} * (1 - CAST(l_discount AS DECIMAL(18,4))) AS DECIMAL(18,4))"
# Of thousands separators, a suffix and a word none is a number; an exponent and spaces are read
SALES = (f"CASE WHEN l_partkey % 7 = 0 THEN format_number({_PRICE}, 2) WHEN l_partkey % 11 = 0 THEN 'NaN' WHEN l_partkey % 13 = 0 THEN concat('  ', {_PRICE}, ' ') "
         f"WHEN l_partkey % 17 = 0 THEN concat({_PRICE}, 'd') WHEN l_partkey % 19 = 0 THEN '1.25e3' ELSE CAST({_PRICE} AS STRING) END")
PAYOUTS = f"IF(l_partkey % 31 = 0, '#N/A', CAST({_PAID} AS STRING))"
HISTORICAL = f"CAST(CAST({_PAID} * 0.5 AS DECIMAL(18,4)) AS STRING)"
ORDER = "CAST(l_orderkey AS STRING)"
NAME = "concat('Shop \"', l_suppkey, '\", main street')"


DD_COLUMNS = [(" Timestamp local date ", DD_DATE), ("Timestamp local time", TIME), ("Merchant store ID", STORE), ("DoorDash order ID", ORDER), ("Store name", NAME),
              ("Subtotal", SALES), ("Net total", PAYOUTS), ("Net total (for historical reference only)", HISTORICAL)]


def campaign_columns(spent: str) -> tuple[list, list]:
    """The columns of a campaign file in two orders; ``spent`` is the header of its spend column."""
    key = "CASE l_returnflag WHEN 'R' THEN 'True' WHEN 'A' THEN 'false' ELSE IF(l_partkey % 37 = 0, '', l_returnflag) END"
    spend = f"CAST(CAST({_PRICE} * CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS STRING)"
    new = "CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_linenumber = 1 THEN '1' ELSE '0' END"
    quantity = "IF(l_partkey % 21 = 0, 'n/a', CAST(l_quantity AS STRING))"
    a = [("Date", DD_DATE), ("Store ID", STORE), (CAMPAIGN_KEY, key), ("Orders", quantity), ("Sales", SALES), (spent, spend), ("New customers acquired (90d)", new)]
    b = [("NEW CUSTOMERS ACQUIRED", new), (spent, spend), ("Sales", SALES), ("Orders", quantity), (CAMPAIGN_KEY, key), ("Shop ID", STORE), ("Date", DD_DATE)]
    return a, b


def _lines(rows: DataFrame, file: str, variants: dict[int, list[tuple[str, str]]], variant: str, banner: str | None) -> DataFrame:
    """File, order within the file and text line of every row, below its header (and banner).
    ``variants`` are lists of (header, SQL of the value)."""
    options = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    keyed = rows.withColumn("_file", F.expr(file)).withColumn("_variant", F.expr(variant))
    parts = []
    for v, columns in variants.items():
        line = F.to_csv(F.struct(*[F.expr(sql).alias(f"c{i}") for i, (_, sql) in enumerate(columns)]), options)
        parts.append(keyed.where(F.col("_variant") == v).select("_file", F.lit(2).alias("_order"), line.alias("line")))
    # One grouping for all variants; ``_order`` is a literal, so who asks for lines or for heads reads the rows only for these.
    found = keyed.where(F.col("_variant").isin(*variants)).select("_file", "_variant").distinct()
    heads = {v: ",".join(f'"{h}"' if "," in h else h for h, _ in columns) for v, columns in variants.items()}
    for order, texts in ([(0, dict.fromkeys(variants, banner))] if banner else []) + [(1, heads)]:
        text = F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col("_variant"))
        parts.append(found.select("_file", F.lit(order).alias("_order"), text.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_lines(lines: DataFrame, folder: str) -> list[str]:
    """One text file per ``_file`` below ``folder``, its lines by ``_order``; the paths.

    A file is one partition and nothing is sorted: the file's first lines (``_order`` 0 and 1,
    as few as the files' names) are put before the first row that its task sees."""
    spark, parts = lines.sparkSession, f"{folder}/_parts-{uuid.uuid4().hex[:6]}"
    heads: dict[str, list] = {}
    for r in lines.where("_order < 2 AND _file IS NOT NULL").select("_file", "_order", "line").collect():
        heads.setdefault(r["_file"], []).append((r["_order"], r["line"]))
    if not heads:
        return []
    names = sorted(heads)
    numbers = spark.createDataFrame([(n, i, "\n".join(t for _, t in sorted(heads[n]))) for i, n in enumerate(names)], "_name string, _number int, _head string")
    on = F.broadcast(numbers.select("_name", "_number")), F.col("_file") == F.col("_name")
    dealt = lines.where("_order = 2").join(*on).select("_number", "line").repartitionById(len(names), "_number")
    placed = dealt.join(F.broadcast(numbers.select("_number", "_head")), "_number").select("_head", "line", (F.monotonically_increasing_id() % (1 << 33) == 0).alias("_first"))
    placed.select(F.expr("IF(_first, concat_ws('\n', _head, line), line)").alias("value")).write.text(parts)
    out = []
    for made in fs.glob(spark, f"{parts}/part-*"):
        path = f"{folder}/{names[int(made.rsplit('/part-', 1)[1].split('-')[0])]}"
        fs.rename(spark, made, path)
        out.append(path)
    return sorted(out)


def _half(prefix: str) -> str:
    return f"concat('{prefix}', year({_DAY}), IF(month({_DAY}) <= 6, '-a', '-b'), '.csv')"


def dd_files(spark: SparkSession, sf_dir: str, staging: Staging) -> list[str]:
    """DD exports: files of odd years have their columns in another order."""
    b = [("Store ID", STORE), ("Net total", PAYOUTS), ("timestamp local date", DD_DATE), ("Order received local time", TIME), (" Subtotal", SALES),
         ("DoorDash order ID ", ORDER), ("Net total (for historical reference only)", HISTORICAL)]
    rows = tv.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    return write_lines(_lines(rows, _half("dd-"), {0: DD_COLUMNS, 1: b}, f"year({_DAY}) % 2", None), staging.path("dd"))


def ue_files(spark: SparkSession, sf_dir: str, staging: Staging) -> list[str]:
    """UE exports: a banner line; date and time stand ninth and tenth in every order."""
    pad = [(f"Extra {i}", "'x'") for i in range(4)]
    a = [("Store ID", STORE), ("Store Name", NAME), ("Order ID", ORDER), *pad, ("Order Status", "'Completed'"), ("Order Date", UE_DATE), ("Accept", TIME),
         ("Sales (excl. tax)", SALES), ("Total payout", PAYOUTS)]
    b = [("Total payout", PAYOUTS), ("Sales (excl. tax)", SALES), ("Shop ID", STORE), *pad, ("Order ID", ORDER), ("Date", UE_DATE), ("Time", TIME)]
    rows = tv.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return write_lines(_lines(rows, _half("ue-"), {0: a, 1: b}, f"year({_DAY}) % 2", "Payout report,all shops"), staging.path("ue"))


def campaign_root(spark: SparkSession, sf_dir: str, staging: Staging) -> str:
    """A marketing folder: per year one ``marketing_*`` folder with two files of each kind."""
    li = tv.table(spark, sf_dir, "lineitem")
    root = staging.path("marketing")
    for status, kind, spent in (("F", "PROMOTION", PROMOTION_SPEND), ("O", "SPONSORED_LISTING", SPONSORED_SPEND)):
        a, b = campaign_columns(spent)
        folder = f"concat('marketing_', year({_DAY}), '-01-01_', year({_DAY}), '-12-31/MARKETING_{kind}_', IF(month({_DAY}) <= 6, 'a', 'b'), '.csv')"
        write_lines(_lines(li.where(F.col("l_linestatus") == status), folder, {0: a, 1: b}, f"CAST(month({_DAY}) > 6 AS INT)", None), root)
    return root


def legacy_files(spark: SparkSession, sf_dir: str, staging: Staging, params) -> tuple[dict[str, str], dict[str, str]]:
    """One new-customer file per window: DD by store and date, UE a single column."""
    new = "CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS STRING)"
    dd, ue = [], []
    for period, (lo, hi) in params.windows.items():
        rows = tv.table(spark, sf_dir, "lineitem").where(f"{_DAY} BETWEEN DATE'{lo}' AND DATE'{hi}'")
        dd.append(_lines(rows.where("l_linestatus = 'F'"), f"'dd-mkt-{period}.csv'", {0: [("Date", _US), ("Store ID", STORE), ("New customers acquired", new)]}, "0", None))
        ue.append(_lines(rows.where("l_linestatus = 'O'"), f"'ue-mkt-{period}.csv'", {0: [("New customers", new)]}, "0", None))
    out = []
    for parts in (dd, ue):
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        paths = write_lines(all_, staging.path("legacy"))
        out.append({p.rsplit("-mkt-", 1)[1].removesuffix(".csv"): p for p in paths})
    return out[0], out[1]


def period_files(spark: SparkSession, sf_dir: str, staging: Staging, params) -> dict[str, str]:
    """One DD export per window, in the column order of even years."""
    out = None
    for period, (lo, hi) in params.windows.items():
        rows = tv.table(spark, sf_dir, "lineitem").where(f"l_linestatus = 'F' AND {_DAY} BETWEEN DATE'{lo}' AND DATE'{hi}'")
        part = _lines(rows, f"'{period}.csv'", {0: DD_COLUMNS}, "0", None)
        out = part if out is None else out.unionByName(part)
    return {p.rsplit("/", 1)[1].removesuffix(".csv"): p for p in write_lines(out, staging.path("periods"))}


def uploaded(spark: SparkSession, sf_dir: str, staging: Staging) -> str:
    """A flat upload folder of promotion files: names with a date range (even years) and without."""
    year = f"CAST(year({_DAY}) AS STRING)"
    name = (f"concat('MARKETING_PROMOTION_', IF(year({_DAY}) % 2 = 0, concat({year}, '-01-01_', {year}, '-12-31'), {year}), "
            f"IF(month({_DAY}) <= 6, '_a', '_b'), '.csv')")
    folder = staging.path("uploads")
    rows = tv.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    write_lines(_lines(rows, name, {0: campaign_columns(PROMOTION_SPEND)[0]}, "0", None), folder)
    return folder


def file_name(column: str = "_src_file"):
    """The last part of a path."""
    return F.substring_index(column, "/", -1)
