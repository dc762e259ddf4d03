import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.llm import maxent, queries
from periodlens.llm.common import read


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(docs):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    count = Counter(w for (_, t), x in zip(docs, held) if not x for w in toks(t))
    n, v = sum(count.values()), len(count)
    out = []
    for (i, t), x in zip(docs, held):
        w = toks(t)
        out.append((i, x, len(w), sum(count[k] > 0 for k in w), n, sum(math.log10((count[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w)))
    return out


def same(rows, docs):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in rows), key=key), sorted(brute(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_table(spark, sf001):
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    rows = queries.op2_language_model(spark, sf001).collect()
    same(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than the base on unseen texts


def test_rare_words_are_joined(spark, sf001, monkeypatch):
    monkeypatch.setattr(maxent, "SHARED_WORDS", 60)
    monkeypatch.setattr(maxent, "FLUSH", 500)
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    few = queries.op2_language_model(spark, sf001).collect()
    same(few, docs)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (None, "A b\x0bC a"), (None, "A b\x0bC a"), (3, "é É " * 30_000), (4, " \t\n"), (5, "x"), (5, "y z"), (6, "a a a a")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, row int, word string").repartition(3)
    rows = maxent.score(df).collect()
    same(rows, docs)
    assert all(math.isfinite(r.score) for r in rows)
    assert maxent.score(df.limit(0)).count() == 0
    only = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    same(maxent.score(only).collect(), [(r.doc_id, r.text) for r in only.collect()])


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    m = maxent.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.log(np.full(maxent.CLASSES, 1 / maxent.CLASSES)).astype(np.float32),
                     rng.normal(0, 1, (maxent.FEATURES, maxent.CLASSES)).astype(np.float32))
    f = rng.integers(0, maxent.FEATURES, (50, maxent.KINDS))
    assert np.exp(m.log_softmax(f)).sum(axis=1) == pytest.approx(np.ones(50), rel=1e-4)


def test_gradient_against_differences(spark):
    """The summed update direction is the slope of the training log likelihood."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat the dog " * 3) for i in range(6)], "doc_id long, text string").repartition(3)
    rows = maxent._rows(docs, "doc_id", "text")
    prior = np.full(maxent.CLASSES, 1 / maxent.CLASSES)
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.3, (maxent.FEATURES, maxent.CLASSES)).astype(np.float32)
    model = maxent.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.log(prior).astype(np.float32), w)
    g, n = maxent.gradient(rows, model)
    import pyarrow as pa

    data = [r.text.encode() for r in docs.collect()]
    row, h, ending = maxent.tokens(pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["bytes"]))
    f, c = maxent.features(row, h), model.classes(h, ending)

    def likelihood():
        return float(model.log_softmax(f).astype(np.float64)[np.arange(len(c)), c].sum())

    for k in np.unique(f)[:5]:
        for j in (int(c[0]), 3):
            old = model.weights[k, j]
            model.weights[k, j] = old + 0.05
            up = likelihood()
            model.weights[k, j] = old - 0.05
            assert g[k, j] == pytest.approx((up - likelihood()) / 0.1, abs=0.05)
            model.weights[k, j] = old
    assert n.sum() == len(c) * maxent.KINDS
