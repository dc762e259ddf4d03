"""Quality rules from tokeniser fertility (operator 4).

A public vocabulary measures each text: characters per token, share of tokens
that are fragments of a character (the bytes that a byte-level vocabulary
falls back to), and entropy of the tokens, as a share of the most it could be, within pieces of
``PIECE`` tokens (the last one ends with the text) so that it does not depend
on the text's length.  Per language, quartiles over all texts that pass the base rules set a band for
each measure; a text outside a band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, as_bytes, joined, mix, slices, windows_hash, words
from .packing import loaded

PIECE = 256
MEASURES = ["chars_per_token", "fallback_share", "entropy"]
#: A band reaches so many quartile distances beyond the quartiles, and at least
#: so far (in the measure's own unit): no spread in the corpus, no narrow band.
REACH = 4.0
LEAST_REACH = {"chars_per_token": 0.2, "fallback_share": 0.05, "entropy": 0.04}
FULL_TOKENS = 1024  # a text of fewer tokens measures less surely: its band is wider by the root of the shortfall
LEAST_ROWS = 20  # texts of a language; below, the band of all languages holds

#: Words without folding case.
EXACT_WORDS = np.arange(256, dtype=np.uint8)
EXACT_WORDS[0] = 1  # NUL is a word character
EXACT_WORDS[list(b" \t\n\x0b\x0c\r")] = 0
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


def repeat_words(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        g = windows_hash(h, 3)
        n = len(g)
        at = np.flatnonzero(row[:n] == row[2 : 2 + n])
        with np.errstate(over="ignore"):
            key = mix(g[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return np.bincount(row[covered], minlength=rows)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\x0b\x0c\r"):
            seen.add(line)
    return n


def entropy(ids: np.ndarray) -> float:
    """Mean over full pieces of ``PIECE`` tokens (the whole text if it is shorter) of token entropy over its maximum."""
    n = len(ids)
    if n < 2:
        return 1.0
    size = min(n, PIECE)
    pieces = np.sort(ids[: n // size * size].reshape(-1, size), axis=1)
    new = np.ones(pieces.shape, bool)
    new[:, 1:] = pieces[:, 1:] != pieces[:, :-1]
    runs = np.diff(np.append(np.flatnonzero(new.reshape(-1)), pieces.size)).astype(np.float64)  # no run spans two pieces
    return float(1 - (runs * np.log2(runs)).sum() / (pieces.size * np.log2(size)))


def text_entropy(ids: np.ndarray) -> float:
    """``entropy`` of all tokens: what follows the last full piece counts, by its length, as the last ``PIECE`` tokens do."""
    rest = len(ids) % PIECE if len(ids) > PIECE else 0
    if not rest:
        return entropy(ids)
    return ((len(ids) - rest) * entropy(ids) + rest * entropy(ids[-PIECE:])) / len(ids)


def measure(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes"),
                       (F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")).alias("lang"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(tokenizer)
        fragment = encode.fragments()
        for b in slices(batches, "bytes"):
            data, starts = joined(b.column("bytes"))
            n = b.num_rows
            begin, end, row, h = words(data, starts, EXACT_WORDS)
            lead = (data & 0xC0) != 0x80  # the first byte of each character
            chars = np.append(0, np.cumsum(lead & (EXACT_WORDS[data] != 0)))
            every = np.append(0, np.cumsum(lead))
            marks = np.append(0, np.cumsum(SYMBOLS[data]))
            out = {"n_words": np.bincount(row, minlength=n), "word_chars": np.diff(chars[starts]), "n_symbols": np.diff(marks[starts]),
                   "n_repeat_words": repeat_words(row, h, n)}
            texts = b.column("bytes").to_pylist()
            out["n_dup_lines"] = np.array([duplicate_lines(t) for t in texts], np.int64)
            ids = [encode(t.decode("utf-8", "replace")) for t in texts]
            tokens = np.array([len(x) for x in ids], np.int64)
            out["n_tokens"] = tokens
            out["chars_per_token"] = np.diff(every[starts]) / np.maximum(tokens, 1)
            out["fallback_share"] = np.array([fragment[x].sum() for x in ids]) / np.maximum(tokens, 1)
            out["entropy"] = np.array([text_entropy(x) for x in ids])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *(pa.array(out[c], t) for c, t in kinds)], ["id", "lang", *(c for c, _ in kinds)])

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
    kinds = [(c, pa.int64()) for c in counts] + [(c, pa.float64()) for c in MEASURES]
    return rows.mapInArrow(work, "id long, lang string, " + ", ".join([f"{c} long" for c in counts] + [f"{c} double" for c in MEASURES]))


def judge(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per document row: (id, lang, counts, measures, base_failed, kept, reasons).

    Base rules: fewer than 50 words, or more than half of the words in repeated
    3-word windows.  ``reasons`` names the measures outside their band, '' for
    none.  A null or empty text has no words, so it fails the base rules; a null
    language is a language of its own; ids may be null or repeat, every row is
    judged.  Languages with few texts use the band of all texts.  An empty table
    gives no rows.  Other columns are not read.
    """
    stages = Stages(docs.sparkSession, "fertility")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stages.put(measure(docs, tokenizer, id_col, text_col, lang_col).withColumn("base_failed", failed))
    passing = rows.where("not base_failed")
    quartiles = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(m) for m in MEASURES]
    of_all = passing.agg(*quartiles).first()
    of_lang = stages.put(passing.groupBy("lang").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= LEAST_ROWS).select(
        F.col("lang").alias("band_lang"), *[F.col(m).alias(f"q_{m}") for m in MEASURES]))
    out = rows.join(of_lang, rows["lang"] == of_lang["band_lang"], "left")
    reasons = []
    unsure = F.sqrt(F.greatest(F.lit(1.0), FULL_TOKENS / F.greatest(F.col("n_tokens"), F.lit(1))))
    for m in MEASURES:
        general = F.array(*[F.lit(x) for x in of_all[m]]) if of_all[m] else F.array(F.lit(0.0), F.lit(0.0))
        q = F.coalesce(F.col(f"q_{m}"), general)
        reach = F.greatest(REACH * (q[1] - q[0]), F.lit(LEAST_REACH[m])) * unsure
        # few fallbacks and much variety are no fault
        low = F.col(m) < q[0] - reach if m != "fallback_share" else F.lit(False)
        high = F.col(m) > q[1] + reach if m != "entropy" else F.lit(False)
        reasons.append(F.when(low | high, F.lit(m)))
    reason = F.concat_ws(",", *reasons)
    return out.select(F.col("id").alias(id_col), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES,
                      "base_failed", (~F.col("base_failed") & (reason == "")).alias("kept"), reason.alias("reasons"))
