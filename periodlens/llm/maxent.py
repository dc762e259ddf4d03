"""Language model scores from a hashed maximum-entropy model (operator 2).

A token's probability is P(class | context) * P(word | class).  Classes are the
most frequent words, one each, and the endings of the other words.  The class
is predicted by a softmax over hashed features of the context: the word before,
the two words before, and the word before that one alone (a skip).  Word
probabilities are smoothed counts over all training texts.

Counting, training and scoring are Spark jobs.  Each gradient update sums what
every task finds in its texts (one row per feature and task) over the whole training part;
the weights themselves have a fixed size.  Counts of frequent words (a bounded
table) are shared with all tasks; the others, which grow with the corpus, are
joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_WORDS, Stages, as_bytes, joined, mix, slices, words

FEATURES = 1 << 14  # fits 16 bits
SINGLES = 19  # the most frequent words have a class each
ENDINGS = 13
CLASSES = SINGLES + ENDINGS
KINDS = 3  # features of a token
SHARED_WORDS = 1 << 18  # words at most whose counts all tasks hold
FLUSH = 1 << 21  # distinct words a task holds before it passes its counts on
RATE, RIDGE, LIMIT = 0.35, 4.0, 4.0
CHUNK = 1 << 13  # tokens whose class probabilities a task holds at a time
END = int(mix(np.array([1], np.uint64))[0])  # the end of a text, a token of its own


def tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, ending) of all tokens of a batch in order, the end of each text included."""
    data, starts = joined(b.column("bytes"))
    begin, end, row, h = words(data, starts, BLANK_WORDS)
    last = BLANK_WORDS[data[end - 1]].astype(np.uint64) if len(end) else np.zeros(0, np.uint64)
    two = np.where(end - begin > 1, BLANK_WORDS[data[np.maximum(end - 2, 0)]], 0).astype(np.uint64) if len(end) else last
    ending = (mix(last * np.uint64(256) + two) % np.uint64(ENDINGS)).astype(np.int64)
    n = b.num_rows
    after = np.searchsorted(row, np.arange(n), side="right")  # an end goes behind each text's words
    return np.insert(row, after, np.arange(n)), np.insert(h, after, np.uint64(END)), np.insert(ending, after, 0)


def features(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Feature numbers (tokens, ``KINDS``); before a text's first word stands nothing (0)."""
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:] = np.where(row[1:] == row[:-1], h[:-1], 0)
    two[2:] = np.where(row[2:] == row[:-2], h[:-2], 0)
    with np.errstate(over="ignore"):
        keys = np.column_stack([mix(one + np.uint64(0x51)), mix(mix(one + np.uint64(0xA3)) + two), mix(two + np.uint64(0xF7))])
    return (keys % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class Model:
    """Bounded by the parameters above, whatever the corpus."""

    singles: np.ndarray  # sorted word hashes, and the class of each
    single_class: np.ndarray
    log_prior: np.ndarray
    weights: np.ndarray

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = SINGLES + ending
        if len(self.singles):
            at = np.minimum(np.searchsorted(self.singles, h), len(self.singles) - 1)
            hit = self.singles[at] == h
            out[hit] = self.single_class[at[hit]]
        return out

    def log_softmax(self, f: np.ndarray) -> np.ndarray:
        z = self.weights[f[:, 0]]
        for k in range(1, KINDS):
            z += self.weights[f[:, k]]
        z += self.log_prior
        # weights within ``LIMIT`` and a prior keep the exponentials in range as they are
        z -= np.log(np.exp(z) @ np.ones(CLASSES, np.float32))[:, None]
        return z


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), as_bytes(text_col).alias("bytes"))


def count_words(training: DataFrame) -> DataFrame:
    """(word, ending, n) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            h, e, n = (np.concatenate(x) for x in zip(*held))
            known, first, back = np.unique(h, return_index=True, return_inverse=True)
            return known, e[first], np.bincount(back, weights=n, minlength=len(known)).astype(np.int64)

        def out(x):
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1], pa.int32()), pa.array(x[2])], ["word", "ending", "n"])

        for b in slices(batches, "bytes"):
            _, h, ending = tokens(b)
            known, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((known, ending[first], n))
            size += len(known)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(merged())

    return training.select("bytes").mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _frequent(counts: DataFrame) -> pa.Table:
    """The words from a count on that at most ``SHARED_WORDS`` words reach (eighths of powers of two)."""
    bin_of = F.floor(F.log2("n") * 8)
    bins = sorted(((r["bin"], r["m"]) for r in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, held = None, 0
    for b, m in bins:
        held += m
        if held > SHARED_WORDS:
            break
        least = b
    return (counts.where(bin_of >= least) if least is not None else counts.limit(0)).select("word", "ending", "n").toArrow()


def gradient(training: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Over all training tokens: observed minus expected classes by feature, and how often each feature stands."""
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(model)
    start = not model.weights.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen = np.zeros(FEATURES * CLASSES)
        expected = np.zeros((FEATURES, CLASSES))
        for b in slices(batches, "bytes"):
            row, h, ending = tokens(b)
            f, c = features(row, h), own.classes(h, ending)
            for k in range(KINDS):
                seen += np.bincount(f[:, k] * CLASSES + c, minlength=len(seen))
            if start:
                continue  # every context expects the prior; added below from the number of tokens
            for at in range(0, len(f), CHUNK):
                part = f[at : at + CHUNK]
                p = np.exp(own.log_softmax(part))
                for k in range(KINDS):
                    column = part[:, k].astype(np.uint16)  # numpy sorts these by counting
                    order = np.argsort(column, kind="stable")
                    column = column[order]
                    new = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
                    expected[column[new]] += np.add.reduceat(p[order], new, axis=0)
        seen = seen.reshape(FEATURES, CLASSES)
        n = seen.sum(axis=1)
        if start:
            expected = n[:, None] * np.exp(own.log_prior)
        some = np.flatnonzero(n)
        g = (seen - expected)[some].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some].astype(np.int64)), pa.array(list(g), pa.list_(pa.float32()))], ["feature", "n", "g"])

    sums = [F.sum(F.col("g")[k]).cast("float").alias(f"g{k}") for k in range(CLASSES)]
    got = training.select("bytes").mapInArrow(run, "feature int, n long, g array<float>").groupBy("feature").agg(F.sum("n").alias("n"), *sums).toArrow()
    g, n = np.zeros((FEATURES, CLASSES)), np.zeros(FEATURES)
    at = got.column("feature").to_numpy()
    n[at] = got.column("n").to_numpy()
    for k in range(CLASSES):
        g[at, k] = got.column(f"g{k}").to_numpy()
    shared.unpersist()
    return g, n


def train(training: DataFrame, frequent: pa.Table, mass: np.ndarray, singles: np.ndarray, updates: int) -> Model:
    """Full-batch updates with a diagonal curvature; the first starts from the class frequencies."""
    prior = mass / mass.sum()
    order = np.argsort(singles)
    model = Model(singles[order], order.astype(np.int64), np.log(prior).astype(np.float32), np.zeros((FEATURES, CLASSES), np.float32))
    for _ in range(updates):
        g, n = gradient(training, model)
        step = RATE * (g - RIDGE * model.weights * 0.01) / (n[:, None] * (prior * (1 - prior)) + RIDGE)
        model.weights = np.clip(model.weights + step, -LIMIT, LIMIT).astype(np.float32)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", updates: int = 2) -> DataFrame:
    """One row per document row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities.

    Learns from the rows whose id, as text, has a crc32 that leaves another
    remainder than 1 by 5 (rows without id are among them).  Null and empty
    texts are the end token alone.  Rows that repeat are scored and counted
    each.  Without training rows every word is unknown.  An empty table gives no
    rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "maxent")
    rows = _rows(docs, id_col, text_col)
    training = rows.where("not held_out")
    counts = stages.put(count_words(training))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = _frequent(counts).sort_by([("n", "descending"), ("word", "ascending")])
    singles = frequent.column("word").to_numpy()[:SINGLES].view(np.uint64)
    mass = np.full(CLASSES, 0.5)  # one unseen word in each class
    mass[: len(singles)] = frequent.column("n").to_numpy()[:SINGLES] + 0.5
    others = counts.where(~F.col("word").isin([int(x) for x in singles.view(np.int64)])) if len(singles) else counts
    for r in others.groupBy("ending").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():  # one row per ending
        mass[SINGLES + r["ending"]] += r["m"]
    model = train(training, frequent, mass, singles, updates)
    order = np.argsort(frequent.column("word").to_numpy().view(np.uint64))
    known = frequent.column("word").to_numpy().view(np.uint64)[order]
    known_log = np.log10(frequent.column("n").to_numpy()[order] + 0.5)
    shared = spark.sparkContext.broadcast((model, np.log10(mass), known, known_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_mass, known, known_log = shared.value
        number = TaskContext.get().partitionId() << 33
        for b in slices(batches, "bytes"):
            rows_n = b.num_rows
            row, h, ending = tokens(b)
            f, c = features(row, h), own.classes(h, ending)
            context = np.empty(len(row))
            for at in range(0, len(f), CHUNK):
                part = slice(at, at + CHUNK)
                context[part] = np.take_along_axis(own.log_softmax(f[part]), c[part, None], axis=1)[:, 0]
            context = context / np.log(10) - log_mass[c]
            hit = np.zeros(len(h), bool)
            top = np.zeros(rows_n)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                top = np.bincount(row[hit], weights=known_log[at[hit]], minlength=rows_n)
            rare_row, rare_h = row[~hit], h[~hit]
            order = np.lexsort((rare_h, rare_row))
            rare_row, rare_h = rare_row[order], rare_h[order]
            new = np.flatnonzero(np.append(True, (rare_row[1:] != rare_row[:-1]) | (rare_h[1:] != rare_h[:-1]))) if len(order) else order
            times = np.diff(np.append(new, len(order)))
            cuts = np.searchsorted(rare_row[new], np.arange(rows_n + 1)) if len(new) else np.zeros(rows_n + 1, np.int64)
            offsets = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + rows_n)), b.column("id"), b.column("held_out"), pa.array(np.bincount(row, minlength=rows_n)),
                 pa.array(np.bincount(row[hit], minlength=rows_n)), pa.array(np.bincount(row, weights=context, minlength=rows_n)), pa.array(top),
                 pa.ListArray.from_arrays(offsets, pa.array(rare_h[new].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                ["row", "id", "held_out", "n_tokens", "n_top", "context", "top", "rare", "times"])
            number += rows_n

    local = stages.put(rows.mapInArrow(run, "row long, id long, held_out boolean, n_tokens long, n_top long, context double, top double, rare array<long>, times array<int>"))
    rare = local.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    looked_up = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rest"))
    rest = stages.put(looked_up)
    stages.drop(counts)
    words_log = F.col("top") + F.coalesce("rest", F.lit(0.0))
    return local.join(rest, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_top") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (words_log - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        (words_log + F.col("context")).alias("score"))
