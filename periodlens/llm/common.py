"""Shared helpers of the training-data operators.

Work inside a task is done on Arrow batches cut into slices of a few MB, so a
task's memory depends on neither the number of rows in a batch nor (beyond a
single text) on the length of its texts.  Everything that crosses tasks is a
Spark shuffle or a table in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.session import checkpoint_dir

SLICE_BYTES = 2 << 20


def importable(spark: SparkSession) -> None:
    """Let Python tasks find this package where the driver found it, from whatever folder the driver runs."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


class Stages:
    """Intermediate tables of one operator call in the shared folder.

    ``put`` writes a table and rereads it, which cuts lineage and survives the
    loss of executors; ``drop`` removes tables that nothing reads any more.
    Tables read by the returned (lazy) result stay until the caller clears the
    shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}
        self.tables: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """A table in ``buckets`` by ``column``: grouping by it later needs no shuffle of this table."""
        self.n += 1
        path, name = f"{self.base}/{self.n}", f"llm_{uuid.uuid4().hex}"
        (df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column)
         .option("path", path).option("compression", "zstd").saveAsTable(name))
        out = self.spark.table(name)
        self.paths[id(out)] = path
        self.tables[id(out)] = name
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now: it does so when the driver's
        references to them are collected, which may otherwise take half an hour."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *dfs: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in dfs:
            if id(df) in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(id(df))}")
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(conf).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_bytes(column) -> F.Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (binary) holds at most ``most`` bytes, or one row."""
    for batch in batches:
        sizes = np.diff(offsets(batch.column(batch.schema.get_field_index(column))))
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start, batch.num_rows - start)


def offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a binary array into its data buffer, as int64."""
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    if len(array) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def joined(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a null-free binary array end to end, and where each row starts (rows + 1 numbers)."""
    at = offsets(array)
    data = array.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


# ----------------------------------------------------------------- words
MULT = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        base = 0xD6E8FEB86659FD93
        ones = np.empty(max(n, SLICE_BYTES + 1), np.uint64)
        with np.errstate(over="ignore"):
            for name, x in (("up", base), ("down", _inverse(base))):
                ones[:] = np.uint64(x)
                ones[0] = 1
                _POWERS[name] = np.multiply.accumulate(ones)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * MULT
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fold_table(separators: bytes) -> np.ndarray:
    """Byte table: separators to 0, A-Z to lower case, other bytes to themselves (0 to 1)."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 1
    table[ord("A") : ord("Z") + 1] += 32
    table[list(separators)] = 0
    return table


#: Words of the contracts: everything between the characters 0x20 and 0x09-0x0D.
BLANK_WORDS = fold_table(b" \t\n\x0b\x0c\r")
#: Words for matching edited text: runs of ASCII letters, digits and non-ASCII characters.
PLAIN_WORDS = fold_table(bytes(i for i in range(128) if not chr(i).isalnum()))


def words(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of joined texts: first byte, byte after the last, row, 64-bit hash of the folded bytes."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    folded = table[data]
    inside = folded != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = starts[:-1][starts[:-1] < n]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = starts[1:][(starts[1:] > 0)] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(folded * up[:n], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    row = np.searchsorted(starts, begin, side="right") - 1
    return begin, end, row, h


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive numbers (len - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = mix(out + h[i : len(h) - n + 1 + i])
    return out
