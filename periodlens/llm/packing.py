"""Best-fit packing planned on a histogram of lengths (operator 7).

Only the number of pieces of each length reaches the driver (at most as many
numbers as a sequence has tokens).  Best fit decreasing runs over those counts:
a step places many pieces of one length into many equal gaps.  The plan is a
list of slot ranges per length, and each piece takes the slot of its rank among
the pieces of its length, a number made of its rank inside its partition and
the partition's offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, as_bytes, slices
from .tokens import ByteBpe

PIECES = "id long, piece int, start long, length long, ids_crc32 long, part long, local long, ids array<int>"
_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones, the first may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = loaded(tokenizer), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for b in slices(batches, "bytes"):
            out: list[tuple] = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("bytes").to_pylist()):
                ids = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + n]
                    out.append((doc, k, start, n, zlib.crc32(own.tobytes()), part, int(seen[n]), own.astype(np.int32) if keep_ids else None))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))],
                ["id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"])

    return rows.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts.  Slot ranges (piece length, first rank,
    how many, first sequence, offset): the pieces of those ranks go to
    consecutive sequences, at that offset."""
    free: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many) of sequences with that gap
    slots, opened = [], 0
    for size in sorted((n for n in counts if counts[n] > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            gap = min((g for g, runs in free.items() if g >= size and runs), default=0)
            if gap:
                first, n = free[gap].pop()
            else:
                gap, first = length, opened
                n = -(-left // (length // size))
                opened += n
            each = min(gap // size, left)
            full = min(n, left // each)  # so many sequences take ``each`` pieces
            if full < n:
                free.setdefault(gap, []).append((first + full, n - full))
            for k in range(each):
                slots.append((size, rank, full, first, length - gap + k * size))
                rank += full
            left -= full * each
            if gap - each * size:
                free.setdefault(gap - each * size, []).append((first, full))
    return slots


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         length: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, ids, sequence_id, offset).

    A document is the ids of its text and then ``end_id``; only a document
    longer than ``length`` is cut.  Null and empty texts are the end id alone;
    ids may be null or repeat, every row is packed.  Pieces of ``length``
    tokens fill a sequence with a negative number; the others get the planned
    sequences 0, 1, ...  An empty table gives no rows.  Other columns are not
    read.  ``keep_ids=False`` leaves ``ids`` null.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "packing")
    cut_up = stages.put(pieces(docs, id_col, text_col, tokenizer, length, end_id, keep_ids))
    short = cut_up.where(F.col("length") < length)
    in_part = stages.put(short.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in in_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most length - 1 rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stages.put(in_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    stages.drop(in_part)
    slots = np.array(plan(counts, length), np.int64).reshape(-1, 5)
    shift = max(counts.values(), default=0) + 1
    starts = slots[:, 0] * shift + slots[:, 1]
    order = np.argsort(starts, kind="stable")
    # bounded by the sequence length: a step of the plan ends a length or empties a run, and runs are a few per length
    shared = spark.sparkContext.broadcast((starts[order], slots[order]))
    names = [f.name for f in cut_up.schema if f.name not in ("part", "local")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = shared.value
        for b in batches:
            if b.num_rows:
                n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
                slot = rows[np.searchsorted(at, n * shift + rank, side="right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in names), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], [*names, "sequence_id", "offset"])

    schema = "id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"
    # a row per partition and length: grows with the input, so it is shuffled, never broadcast
    ranked = short.join(base.hint("shuffle_hash"), ["part", "length"]).select(*names, (F.col("base") + F.col("local")).alias("rank"))
    planned = ranked.mapInArrow(place, schema)
    alone = cut_up.where(F.col("length") == length).select(
        *names, (-1 - F.col("part") * F.lit(1 << 33) - F.col("local")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return planned.unionByName(alone).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids), pieces in the order of their offsets."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
