"""Language identification by Bayesian fusion of evidence (operator 6).

Four kinds of evidence are multiplied:

* the text: a multinomial model over hashed byte 4-grams per language, whose
  counts are gathered over the whole table under the declared languages;
* the declared markup language: how often each declaration goes with each
  language that the texts alone suggest;
* the address suffix and the host: a prior per host, smoothed towards its
  domain, that towards its suffix, and that towards all rows.  These are
  grouped counts, joined to the rows by host.

A row is rejected if it has no letters to judge by, if its n-grams are rarer
under every language than under equal chances for all n-grams (no language
explains it), or if no language reaches ``min_posterior``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .common import Stages, as_bytes, joined, slices

BUCKETS = 1 << 14
GRAM = 4
MIN_SUPPORT = 5  # rows that declare a language before it counts as one
EVIDENCE = 40.0  # n-grams of one text overlap and repeat; all of them together weigh as so many independent ones
SMOOTH = 0.5
STRENGTH = 10.0  # rows that a parent's prior is worth

#: Columns that the operator adds.
RESULT = ["language", "posterior", "text_language", "n_grams", "accepted"]


def declared_code(column) -> F.Column:
    """Primary language of a declaration: 'en-US' -> 'en'; null and other text -> ''."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)


def host_of(url) -> F.Column:
    """Host of an address, in lower case; null for none."""
    c = F.col(url) if isinstance(url, str) else url
    return F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: F.Column) -> F.Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: F.Column) -> F.Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise(F.lit(""))


def markup_language(html) -> F.Column:
    """Language that the html element declares; '' for none."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(c, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def visible_text(html) -> F.Column:
    """Text of a page good enough to tell its language: no head, menus, footers, scripts, markup or references."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style|head|nav|footer|aside)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(c, r"<[^>]*>|&#?\w+;", " ")


# ------------------------------------------------------------ byte n-grams
def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = 32  # digits, marks and white space all separate
    return table


FOLD = _fold()


def buckets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each byte 4-gram that holds at least three letters; none goes across texts."""
    if len(data) < GRAM:
        none = np.zeros(0, np.int64)
        return none, none
    x = FOLD[data]
    n = len(x) - GRAM + 1
    code = x[:n] | x[1 : n + 1] << 8 | x[2 : n + 2] << 16 | x[3 : n + 3] << 24
    letters = (x != 32).view(np.uint8)
    ok = letters[:n] + letters[1 : n + 1] + letters[2 : n + 2] + letters[3 : n + 3] >= 3
    for k in range(1, GRAM):
        cut = starts[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(ok)
    bucket = (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return np.searchsorted(starts, at, side="right") - 1, bucket.astype(np.int64)


def _language_counts(rows: DataFrame) -> DataFrame:
    """(code, bucket, n) over all rows with a declared language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "bytes"):
            data, starts = joined(b.column("bytes"))
            text, bucket = buckets(data, starts)
            codes = b.column("code").to_pylist()
            names = sorted(set(codes) - {""})
            number = np.array([names.index(c) if c else -1 for c in codes], np.int64)[text]
            for k, name in enumerate(names):
                if name not in total:
                    total[name] = np.zeros(BUCKETS, np.int64)
                total[name] += np.bincount(bucket[number == k], minlength=BUCKETS)
            if len(total) > 64:  # bounded memory however many declarations there are
                yield from _rows(total)
                total = {}
        yield from _rows(total)

    def _rows(total):
        for name, n in total.items():
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(n[some])], ["code", "bucket", "n"])

    return rows.select("code", "bytes").mapInArrow(run, "code string, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))


class TextModel:
    """Log likelihoods of buckets per language, against equal chances for all buckets."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + SMOOTH) / (counts.sum(axis=0, keepdims=True, dtype=np.float64) + SMOOTH * BUCKETS)
        self.table = np.log(p * BUCKETS).astype(np.float32)

    def sums(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, log likelihood ratio per language) of each text."""
        text, bucket = buckets(data, starts)
        rows = len(starts) - 1
        n = np.bincount(text, minlength=rows)
        total = np.zeros((rows, len(self.languages)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(text, weights=self.table[bucket, k], minlength=rows)
        return n, total


def fit(rows: DataFrame) -> TextModel:
    """Text model of all declared languages with at least ``MIN_SUPPORT`` rows.

    Codes have two or three letters, so their number is bounded; each costs ``BUCKETS`` numbers here."""
    support = rows.where("code <> ''").groupBy("code").count().where(F.col("count") >= MIN_SUPPORT)
    languages = sorted(r["code"] for r in support.select("code").collect())
    counts = np.zeros((BUCKETS, len(languages)), np.float32)
    at = {c: k for k, c in enumerate(languages)}
    if languages:
        known = rows.join(support.select("code").hint("broadcast"), "code", "left_semi")
        for r in _language_counts(known).groupBy("code").agg(  # a row of at most BUCKETS numbers per code
                F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toLocalIterator():
            counts[r["bucket"], at[r["code"]]] = r["n"]
    return TextModel(languages, counts)


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    """Every column of ``rows`` but ``__lid_bytes``, with ``__lid_n`` and ``__lid_text`` (log evidence per language)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if f.name != "__lid_bytes"]
    at = [i for i, f in enumerate(rows.schema.fields) if f.name != "__lid_bytes"]
    names = [f.name for f in kept] + ["__lid_n", "__lid_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches, "__lid_bytes"):
            data, starts = joined(b.column(b.schema.get_field_index("__lid_bytes")))
            n, total = own.sums(data, starts)
            weight = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
            evidence = pa.array(list((total * weight[:, None]).astype(np.float64)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), pa.array(n, pa.int64()), evidence], names)

    schema = StructType(kept).add("__lid_n", LongType()).add("__lid_text", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)


def _argmax(values: str) -> F.Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def identify(rows: DataFrame, text_col: str, declared_col: str | None, url_col: str | None = None, host_col: str | None = None,
             min_posterior: float = 0.5) -> DataFrame:
    """``rows`` with the columns ``RESULT`` added.

    ``language`` is the most probable language ('und' if the row is rejected
    for want of evidence), ``posterior`` its probability, ``text_language`` what
    the text alone suggests, ``n_grams`` the evidence in the text, ``accepted``
    the decision.  Null and empty texts have no n-grams and are rejected; a null
    or unreadable declaration or address only removes that evidence; ties go to
    the language that sorts first.  Repeated rows give equal rows.  With no
    language to learn, or no rows, nothing is accepted.  An input column named
    like a result column is replaced; others are kept, whatever their names.
    Every declared code with at least ``MIN_SUPPORT`` rows has a model (memory: 64 KB
    per code and task, and codes are two or three letters).
    """
    own = {c: f"in{i}_{len(rows.columns)}" for i, c in enumerate(rows.columns) if c.lower().startswith("__lid_")}
    if own:
        found = identify(rows.withColumnsRenamed(own), *[own.get(c, c) for c in (text_col, declared_col, url_col, host_col)], min_posterior)
        return found.withColumnsRenamed({v: c for c, v in own.items()})
    stages = Stages(rows.sparkSession, "langid")
    base = rows.drop(*RESULT)
    host = F.coalesce(host_of(url_col) if url_col else F.lit(None), F.lower(F.col(host_col)) if host_col else F.lit(None), F.lit("").cast("string"))
    keyed = base.withColumns({
        "__lid_bytes": as_bytes(text_col),
        "__lid_code": declared_code(declared_col) if declared_col else F.lit(""),
        "__lid_host": host,
    })
    model = fit(keyed.select(F.col("__lid_code").alias("code"), F.col("__lid_bytes").alias("bytes")))
    names = model.languages
    if not names:
        return base.withColumns({"language": F.lit("und"), "posterior": F.lit(0.0), "text_language": F.lit("und"),
                                 "n_grams": F.lit(0).cast("long"), "accepted": F.lit(False)})
    size = len(names)
    language = F.array(*map(F.lit, names))
    # first pass over the texts: what they suggest by themselves, counted by declaration and by host
    slim = keyed.select("__lid_bytes", "__lid_code", "__lid_host")
    counts = stages.put(_text_scores(slim, model).where("__lid_n > 0").select(
        "__lid_code", "__lid_host", _argmax("__lid_text").alias("k")).groupBy("__lid_host", "__lid_code", "k").count())
    seen = np.full((size + 1, size), SMOOTH)  # declaration (none or unknown last) by language
    at = {c: k for k, c in enumerate(names)}
    known = F.when(F.col("__lid_code").isin(names), F.col("__lid_code"))
    for r in counts.groupBy(known.alias("code"), "k").agg(F.sum("count").alias("n")).toLocalIterator():  # at most (size + 1) * size rows
        seen[at.get(r["code"], size), r["k"]] += r["n"]
    declared = np.log(seen / seen.sum(axis=0, keepdims=True))  # no row for no usable declaration: no evidence
    of_code = rows.sparkSession.createDataFrame([(c, [float(x) for x in declared[k]]) for k, c in enumerate(names)], "__lid_known string, __lid_declared array<double>")
    priors = _host_priors(counts, size, stages)
    stages.drop(counts)
    # second pass: the text again, with everything else joined to it
    scored = _text_scores(keyed, model)
    # a host without any readable text has no row of its own: all languages alike
    with_prior = scored.join(priors.withColumnRenamed("__lid_host", "__lid_prior_host"), F.col("__lid_host") == F.col("__lid_prior_host"), "left")
    with_prior = with_prior.join(F.broadcast(of_code), F.col("__lid_code") == F.col("__lid_known"), "left")  # a row per code, of which there are a bounded number
    none = F.array_repeat(F.lit(0.0), size)
    evidence = F.zip_with(F.zip_with("__lid_text", F.coalesce("__lid_declared", none), lambda a, b: a + b),
                          F.coalesce("__lid_prior", none), lambda a, b: a + b)
    with_all = with_prior.withColumn("__lid_all", evidence)
    weights = F.transform("__lid_all", lambda x: F.exp(x - F.array_max("__lid_all")))
    posterior = F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    best = F.element_at(language, _argmax("__lid_all") + 1)
    readable = (F.col("__lid_n") > 0) & (F.array_max("__lid_text") > 0)
    out = with_all.withColumns({"__lid_posterior": posterior, "__lid_best": best, "__lid_readable": readable})
    return out.select(
        *[F.col(f"`{c}`") for c in base.columns],
        F.when(F.col("__lid_readable"), F.col("__lid_best")).otherwise("und").alias("language"),
        F.when(F.col("__lid_readable"), F.col("__lid_posterior")).otherwise(0.0).alias("posterior"),
        F.when(F.col("__lid_n") > 0, F.element_at(language, _argmax("__lid_text") + 1)).otherwise("und").alias("text_language"),
        F.col("__lid_n").alias("n_grams"),
        (F.col("__lid_readable") & (F.col("__lid_posterior") >= min_posterior)).alias("accepted"))


def accepted_rows(docs: DataFrame, text_col: str, declared_col: str | None, url_col: str | None = None, host_col: str | None = None,
                  min_posterior: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is identified; columns unchanged, whatever their names."""
    names = docs.columns
    own = {c: f"in{i}" for i, c in enumerate(names)}
    found = identify(docs.toDF(*own.values()), *[own[c] if c else None for c in (text_col, declared_col, url_col, host_col)], min_posterior)
    return found.where("accepted").select(*[F.col(v).alias(c) for c, v in own.items()])


def _host_priors(counts: DataFrame, size: int, stages: Stages) -> DataFrame:
    """(host, log prior per language), smoothed host -> domain -> suffix -> all rows.

    Each level is a table, so Spark can split the hosts of a frequent suffix."""
    host = F.col("__lid_host")

    def dense(tallies: DataFrame, *keys: str) -> DataFrame:
        """One row per key with the number of rows of each language (at most ``size`` entries are collected)."""
        entries = F.collect_list(F.struct("k", F.col("n").cast("double")))
        held = tallies.groupBy(*keys).agg(F.map_from_entries(entries).alias("m"))
        return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("n"))

    of_host = counts.groupBy("__lid_host", "k").agg(F.sum("count").alias("n")).select(
        "__lid_host", domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), "k", "n")
    tallied = stages.put(of_host)
    by_domain_k = stages.put(tallied.groupBy("domain", "suffix", "k").agg(F.sum("n").alias("n")))
    by_suffix_k = stages.put(by_domain_k.groupBy("suffix", "k").agg(F.sum("n").alias("n")))
    by_host = dense(tallied, "__lid_host", "domain", "suffix")
    by_domain = dense(by_domain_k, "domain", "suffix")
    by_suffix = dense(by_suffix_k, "suffix")
    every = np.zeros(size)
    for r in by_suffix_k.groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row per language
        every[r["k"]] = r["n"]
    overall = (every + STRENGTH / size) / (every.sum() + STRENGTH)

    def smoothed(parent: F.Column) -> F.Column:
        total = F.aggregate("n", F.lit(0.0), lambda a, b: a + b)
        return F.zip_with("n", parent, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))

    of_suffix = stages.put(by_suffix.select("suffix", smoothed(F.array(*[F.lit(float(p)) for p in overall])).alias("up")))
    of_domain = stages.put(by_domain.join(of_suffix, "suffix").select("domain", "suffix", smoothed(F.col("up")).alias("up")))
    of_each = by_host.join(of_domain, ["domain", "suffix"]).select("__lid_host", smoothed(F.col("up")).alias("p"))
    out = stages.put(of_each.select("__lid_host", F.transform("p", lambda p: F.log(p)).alias("__lid_prior")))
    stages.drop(tallied, by_domain_k, by_suffix_k, of_suffix, of_domain)
    return out
