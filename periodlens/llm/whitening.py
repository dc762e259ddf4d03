"""Whitening of embedding vectors (operator 11).

Entries become whole numbers (``floor(scale * c) + shift``), so counts, sums and
deviations are exact.  Four passes over the vectors (step 3 is none), which are
never shuffled:

1. number of vectors and sums per dimension (grouped sums of whole numbers);
2. blockwise QR: a task folds its centred rows, batch by batch, into one
   triangle; triangles are merged sixteen at a time until one is left;
3. on the driver, the triangle (dimensions squared, whatever the number of rows)
   is made bidiagonal, dqds gives its singular values and twisted
   factorisations the directions (``bidiagonal``);
4. the covariance of the whitened rows, from moments of batches, centred before
   they are multiplied and merged in the same way;
5. the projections of every row.

Nulls: a null vector, or one with a null, infinite or NaN entry (or one whose
whole number does not fit in 62 bits), is dropped; a null id is carried.  All
vectors of a table have one length: the commonest (of equally common ones the
greater); others are neither fitted nor returned.  Components of no variance
(up to rounding) cannot be whitened and are not returned, so a table whose
vectors are all equal, or an empty one, gives no rows.  Repeated rows count and
are returned once each.  Texts play no part; vectors of any length work within a
task's memory.  ``deviation`` is null where the exact number does not fit in a
long.  Columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bidiagonal
from .common import Stages

ROWS = 2048
FAN = 16
OUT = "id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """A fitted whitening: ``n`` vectors, per dimension the sum of the whole numbers, and per
    component its direction (columns), eigenvalue and share of the variance."""
    n: int
    sums: list[int]
    scale: int
    shift: int
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)


def whole(vectors: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and whole numbers of the usable vectors of a batch, one array per vector length."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten()
    x = np.floor(np.asarray(flat.fill_null(np.nan)) * scale)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(x) < 2.0**62)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    wrong = np.zeros(len(x) + 1, np.int64)
    np.cumsum(bad, out=wrong[1:])
    usable = (lengths >= 0) & (wrong[starts + np.maximum(lengths, 0)] == wrong[starts])
    for length in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == length))
        at = starts[rows][:, None] + np.arange(length)[None, :]
        yield rows, x[at].astype(np.int64) + shift


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _own(batches: Iterator[pa.RecordBatch], model: Model, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the rows that belong to the model and their whole numbers."""
    for batch in _parts(batches):
        for rows, x in whole(batch.column(batch.schema.get_field_index(column)), model.scale, model.shift):
            if x.shape[1] == model.dims and model.dims:
                yield batch, rows, x


def _off_mean(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``x`` less the floor of its mean, and what the mean has above its floor times n."""
    floor = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s % model.n for s in model.sums], np.int64)
    return x - floor, rest


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """``x - S / n``, the whole part subtracted exactly."""
    d, rest = _off_mean(x, model)
    return d.astype(np.float64) - rest.astype(np.float64) / model.n


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of ``(n x - S) ** 2``, exact; None beyond a long."""
    d, rest = _off_mean(x, model)
    top = int(np.abs(d).max(initial=0))
    if top * max(top, model.n) * model.dims >= 1 << 62:
        d, rest = d.astype(object), rest.astype(object)
    squares, mixed = (d * d).sum(1), (d * rest).sum(1)
    tail, n = sum(int(r) ** 2 for r in rest), model.n
    out = [n * n * int(a) - 2 * n * int(b) + tail for a, b in zip(squares, mixed)]
    return [v if v < 1 << 63 else None for v in out]


# ----------------------------------------------------------------- passes
def _sums(stages: Stages, vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in _parts(batches):
            for _, x in whole(batch.column(0), scale, shift):
                own = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(x)
                high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
                own[1] = [s + (int(h) << 32) + int(w) for s, h, w in zip(own[1], high, low)]
        for length, (n, sums) in held.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([length] * max(1, length), pa.int32()), "dim": pa.array(range(max(1, length)), pa.int32()),
                                              "n": pa.array([n] * max(1, length), pa.int64()), "s": pa.array([str(s) for s in sums] or ["0"])})

    found = stages.put(vectors.select("v").mapInArrow(count, "dims int, dim int, n long, s string")
                       .groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")))
    most = found.where("dim = 0").orderBy(F.col("n").desc(), F.col("dims").desc()).select("dims", "n").first()
    if most is None or most[0] == 0:
        return 0, []
    return most[1], [int(r[0]) for r in found.where(F.col("dims") == most[0]).orderBy("dim").select("s").collect()]


def merged(stages: Stages, blocks: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One block from all: neighbours by task number are merged, ``FAN`` at a time."""
    def together(table):
        rows = table.sort_by("id").to_pydict()
        return pa.table({"id": pa.array([rows["id"][0] // FAN], pa.int64()), "block": pa.array([merge(rows["block"])], pa.binary())})

    blocks = stages.put(blocks)
    while (blocks.agg(F.max("id")).first()[0] or 0) > 0:
        blocks = stages.put(blocks.groupBy(F.expr(f"id div {FAN}").alias("g")).applyInArrow(together, "id long, block binary"))
    last = blocks.first()
    return None if last is None else bytes(last["block"])


def _fold(batches, model: Model, start, step: Callable, done: Callable) -> Iterator[pa.RecordBatch]:
    state = start
    for _, _, x in _own(batches, model, "v"):
        state = step(state, x)
    if state is not start:
        yield pa.RecordBatch.from_pydict({"id": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([done(state)], pa.binary())})


def _triangle(stages: Stages, vectors: DataFrame, model: Model) -> np.ndarray:
    dims = model.dims

    def qr(rows: np.ndarray) -> np.ndarray:
        out = np.linalg.qr(rows, mode="r")
        return out if len(out) == dims else np.vstack([out, np.zeros((dims - len(out), dims))])

    def step(r, x):
        return qr(np.vstack([r, centred(x, model)]))

    def merge(blocks: list[bytes]) -> bytes:
        return qr(np.vstack([np.frombuffer(b).reshape(dims, dims) for b in blocks])).tobytes()

    found = merged(stages, vectors.select("v").mapInArrow(
        lambda it: _fold(it, model, np.zeros((dims, dims)), step, lambda r: r.tobytes()), "id long, block binary"), merge)
    return np.frombuffer(found).reshape(dims, dims)


def project(x: np.ndarray, model: Model) -> np.ndarray:
    """Whitened rows: one column per component."""
    return centred(x, model) @ (model.directions / np.sqrt(model.values))


def _identity_error(stages: Stages, vectors: DataFrame, model: Model) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k = model.directions.shape[1]

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Moments of two disjoint sets of rows: number, mean, centred products."""
        if a[0, 0] == 0:
            return b
        n = a[0, 0] + b[0, 0]
        off = b[1] - a[1]
        out = a + b
        out[0, 0] = n
        out[1] = a[1] + off * (b[0, 0] / n)
        out[2:] += np.outer(off, off) * (a[0, 0] * b[0, 0] / n)
        return out

    def step(state, x):
        w = project(x, model)
        mean = w.mean(0)
        w = w - mean
        own = np.zeros((k + 2, k))
        own[0, 0], own[1], own[2:] = len(w), mean, w.T @ w
        return both(state, own)

    def merge(blocks: list[bytes]) -> bytes:
        out = np.zeros((k + 2, k))
        for b in blocks:
            out = both(out, np.frombuffer(b).reshape(k + 2, k))
        return out.tobytes()

    found = merged(stages, vectors.select("v").mapInArrow(
        lambda it: _fold(it, model, np.zeros((k + 2, k)), step, lambda s: s.tobytes()), "id long, block binary"), merge)
    m = np.frombuffer(found).reshape(k + 2, k)
    return float(np.abs(m[2:] / m[0, 0] - np.eye(k)).max())


def fit(table: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> Model:
    """The whitening of all usable vectors of ``table``."""
    stages = Stages(table.sparkSession, "whitening")
    vectors = table.select(F.col(vector_col).cast("array<double>").alias("v"))
    n, sums = _sums(stages, vectors, scale, shift)
    none = np.zeros((len(sums), 0))
    model = Model(n, sums, scale, shift, none, np.zeros(0), np.zeros(0))
    if not n:
        return model
    squares, directions = bidiagonal.right_vectors(_triangle(stages, vectors, model))
    kept = int((squares > (bidiagonal.EPS * max(n, model.dims)) ** 2 * squares[0]).sum()) if squares[0] > 0 else 0
    kept = min(kept, components)
    directions = directions[:, :kept]
    largest = directions[np.abs(directions).argmax(0), np.arange(kept)] if kept else np.zeros(0)
    model.directions = directions * np.where(largest < 0, -1.0, 1.0)
    model.values, model.explained = squares[:kept] / n, squares[:kept] / max(squares.sum(), np.finfo(float).tiny)
    if kept:
        model.identity_error = _identity_error(stages, vectors, model)
    return model


def transform(table: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    k = len(model.values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, x in _own(batches, model, "v"):
            if not k:
                continue
            times = pa.array(np.repeat(own, k))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(times), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(len(x) * k, model.n), "deviation": pa.array(deviations(x, model), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": project(x, model).ravel(), "explained": np.tile(model.explained, len(x)),
                "identity_error": np.full(len(x) * k, model.identity_error)})

    return rows.mapInArrow(out, OUT.format(kind)).withColumnRenamed("id", id_col)


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Fits the whitening to all usable vectors and applies it to each of them."""
    return transform(table, fit(table, vector_col, components, scale, shift), id_col, vector_col)
