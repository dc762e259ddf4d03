import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.llm import bidiagonal, queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def usable(rows):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = {}
    for _, v in ok:
        sizes[len(v)] = sizes.get(len(v), 0) + 1
    most = max(sizes, key=lambda k: (sizes[k], k), default=0)
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in ok if len(v) == most]


def check(rows, got, components=32):
    """Against plain whole numbers and the eigenvectors of the covariance."""
    kept = usable(rows)
    n, x = len(kept), np.array([v for _, v in kept], dtype=object)
    sums = x.sum(0)
    off = np.array(n * x - sums, dtype=np.float64) / n
    cov = off.T @ off / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    want = {}
    for (i, v), o in zip(kept, off):
        want.setdefault((i, sum(int(n * a - s) ** 2 for a, s in zip(v, sums))), []).append(o)
    assert set(by) == set(want)
    white = np.zeros((n, k))
    at = 0
    for key, os in want.items():
        assert sorted(by[key]) == list(range(1, k + 1)) and all(len(x) == len(os) for x in by[key].values())
        for j, o in enumerate(os):
            white[at] = [sorted(by[key][c], key=lambda r: r["whitened"])[j]["whitened"] if len(os) > 1 else by[key][c][0]["whitened"] for c in range(1, k + 1)]
            at += 1
    order = np.array([o for os in want.values() for o in os])
    if len(by) == n and np.all(np.diff(values[: k + 1]) < -1e-6 * values[0]):
        for c in range(k):
            ref = order @ vectors[:, c] / math.sqrt(values[c])
            sign = 1 if ref @ white[:, c] > 0 else -1
            np.testing.assert_allclose(white[:, c], sign * ref, atol=1e-8)
    for r in got[:200]:
        assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-8
        assert r["identity_error"] == got[0]["identity_error"] < 1e-8
    if len(by) == n:
        w = white - white.mean(0)
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8


def vectors(n, d, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(3, 1, d) if rank is None else rng.integers(-3, 4, size=(n, rank)) @ rng.integers(-2, 3, size=(rank, d))
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("n,d,parts", [(500, 12, 40), (300, 40, 3), (10, 16, 4), (1, 4, 1), (2, 1, 2)])
def test_against_eigenvectors(spark, n, d, parts):
    rows = vectors(n, d)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    if n == 1:
        assert got == []
    else:
        check(rows, got)


def test_bad_rows_ties_and_other_lengths(spark):
    rows = vectors(200, 6, 4)
    rng = random.Random(1)
    rows += [(None, rows[3][1]), rows[5], rows[5]] + [(900 + i, v) for i, v in enumerate(
        [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] + [0.0] * 5, [math.inf] * 6, [0.5] * 5, [1e30] + [0.0] * 5])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("id", "v", "n", "component", "dims", "block", "whitened"):
        docs = docs.withColumn(c, F.lit("x"))
    got = whitening.whiten(docs).collect()
    check([r for r in rows if not (r[1] and r[1][0] == 1e30)], got)
    assert {r["vec_id"] for r in got} == {None, *range(200)}


def test_low_rank_equal_and_empty(spark):
    rows = vectors(150, 8, 2, rank=3)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2, 3}
    check(rows, got)
    assert whitening.whiten(spark.createDataFrame([(i, [1.5, 2.0]) for i in range(9)], SCHEMA)).collect() == []
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        empty = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_deviation_is_exact_or_null():
    model = whitening.Model(3_000_000_000, [3_000_000_000 * 1_000_000 + 7, 5], 64, 0, np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[1_000_000, 0], [1_000_001, 0], [1_000_002, -1]])
    exact = [sum((model.n * int(a) - s) ** 2 for a, s in zip(v, model.sums)) for v in x]
    assert whitening.deviations(x, model) == [e if e < 1 << 63 else None for e in exact] and None in whitening.deviations(x, model)


@pytest.mark.parametrize("seed", range(6))
def test_singular_values_and_vectors(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 40))
    u, v = (np.linalg.qr(rng.normal(size=(n, n)))[0] for _ in range(2))
    s = [rng.random(n) + 0.1, 10.0 ** -rng.integers(0, 12, n), 1 + 1e-7 * rng.random(n), np.where(rng.random(n) < 0.4, 0.0, 1.0), np.ones(n),
         np.repeat(rng.random(n // 2 + 1), 2)[:n]][seed]
    r = np.linalg.qr(u @ np.diag(s) @ v.T, mode="r")
    squares, vectors_ = bidiagonal.right_vectors(r)
    np.testing.assert_allclose(squares, np.sort(s)[::-1] ** 2, atol=1e-14 * max(1, s.max()))
    assert np.abs(vectors_.T @ vectors_ - np.eye(n)).max() < 1e-11
    assert np.abs(r.T @ (r @ vectors_) - vectors_ * squares).max() < 1e-13


def test_values_are_relatively_accurate():
    """Graded bidiagonal matrices: every value to high relative accuracy, however small."""
    rng = np.random.default_rng(8)
    a, b = 10.0 ** -np.arange(12) * (1 + rng.random(12)), 10.0 ** -np.arange(11) * rng.random(11)
    from fractions import Fraction
    got = bidiagonal.squared_values(a, b)
    product = math.prod(Fraction(float(x)) ** 2 for x in a)
    assert abs(float(math.prod(Fraction(float(x)) for x in got) / product) - 1) < 1e-13


def test_query(spark, sf001):
    got = queries.op11_whitening(spark, sf001)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    rows = [(r[0], None if r[1] is None else list(r[1])) for r in spark.read.parquet(f"{sf001}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, got.collect())
