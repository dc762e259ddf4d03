"""Exact substring deduplication by suffix arrays (operator 5).

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
text of a smaller id.  The suffixes of the whole corpus are too many to send
around, so equal strings are brought together by content first:

1.  The texts are dealt into parts, written once as a bucketed table.  Of several
    equal texts one with the least id is searched; the others go whole.
2.  The least hash of the 20-byte strings inside a string of ``LENGTH`` bytes is
    its key.  Neighbouring strings mostly have the same key; such a run of
    strings is a window.  Only the keys of each part of the corpus are
    shuffled, as packed numbers, and the keys that occur twice come back.
3.  Windows of those keys meet by key, equal windows of a part once.  A task
    orders the suffixes of its windows by two-stage sorting (``suffix``), and the
    common prefixes of neighbours in that order give every string the least id that has it.
4.  Each part learns which of its windows' strings a smaller id has, and cuts.

A key found in very many windows (a common phrase, or the edge of a common
passage) is replaced by the hash of 47 bytes that four neighbouring strings
share, so such windows spread over many tasks and still meet exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix
from .common import SLICE_BYTES, Stages, _powers, as_bytes, joined, mix, slices

LENGTH = 50
GRAM = 20
BLOCK = 4  # neighbouring strings under one key where windows are many
MANY = 1000  # windows of a key from which it is replaced
MOST_OWN = 63  # strings of a window
PART_BYTES = 8 << 20
BUCKET_BYTES = 128 << 20  # of text, whose keys one task compares
CHUNK_BYTES = 2 << 20  # of windows, sorted at a time
KEY_BYTES = 32 << 20  # of text, whose windows one task compares
MOST_BUCKETS = 50_000  # of the table of texts, half of what Spark allows; more parts than that share buckets
NO_ID = (1 << 63) - 1  # stands for a null id, so that it is the largest


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    m = 0x9E3779B97F4A7C15
    powers = [np.uint64(pow(m, k, 1 << 64)) for k in (1, 2, 4, 8)]
    x = data.astype(np.uint64) + np.uint64(1)
    level = [x]
    for k in range(4):
        x = level[-1]
        level.append(x[: -(1 << k)] * powers[k] + x[1 << k :])
    return mix(level[4][:-4] * powers[2] + level[2][16:])


def sliding_least(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have, x = 1, g
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, strings, key) of the windows of joined texts, and the hashes of all places."""
    g = gram_hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), g
    least = sliding_least(g, LENGTH - GRAM + 1)
    n = len(least)
    valid = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(starts) >= LENGTH)
    valid[starts[long]] += 1
    valid[starts[long + 1] - LENGTH + 1] -= 1
    valid = np.cumsum(valid)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    new[starts[long]] = True
    new &= valid
    stop = new | ~valid
    first = np.flatnonzero(new)
    edges = np.append(np.flatnonzero(stop), n)
    size = edges[np.searchsorted(edges, first, side="right")] - first
    pieces = -(-size // MOST_OWN)  # repetitive text: one key for long
    at = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MOST_OWN
    own = np.minimum(np.repeat(first + size, pieces) - at, MOST_OWN)
    return np.searchsorted(starts, at, side="right") - 1, at, own, least[at], g


class Sums:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def windows(data: np.ndarray, starts: np.ndarray, shared: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first place, strings, key, content hash) of the windows whose keys are among the sorted ``shared``;
    those of the keys flagged in ``many`` are cut in blocks with keys of their own."""
    text, at, own, key, g = runs(data, starts)
    if len(shared):
        where = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        hit = shared[where] == key
    else:
        where, hit = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    text, at, own, key, split = text[hit], at[hit], own[hit], key[hit], many[where[hit]] if len(shared) else hit[:0]
    content = Sums(data)
    out = [(text[~split], at[~split], own[~split], key[~split])]
    if split.any():
        rows = np.flatnonzero(split)
        n = own[rows]
        row = np.repeat(rows, n)
        s = at[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        offset = np.full(len(s), -1, np.int64)  # from a string to the place of its key
        for o in range(LENGTH - GRAM + 1):
            offset[(offset < 0) & (g[s + o] == key[row])] = o
        block = offset // BLOCK
        place = s + offset
        new = np.ones(len(s), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        core = place[first] - BLOCK * block[first]  # the last string that the block can have starts here
        out.append((text[row[first]], s[first], np.diff(np.append(first, len(s))), content(core, core + LENGTH - BLOCK + 1)))
    text, at, own, key = (np.concatenate(x) for x in zip(*out))
    return text, at, own, key, content(at, at + own + LENGTH - 1)


# --------------------------------------------------------------------- parts
def _searched(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a part that are searched: of equal texts the first row of the least id."""
    listed = right.filter(right.column("sha").is_valid())
    least = dict(zip(listed.column("sha").to_pylist(), listed.column("id").to_pylist()))
    keep = []
    for row, (sha, i) in enumerate(zip(left.column("sha").to_pylist(), left.column("id").to_pylist())):
        if least.get(sha) == i:
            keep.append(row)
            del least[sha]
    return left.take(pa.array(keep, pa.int64())) if len(keep) < left.num_rows else left


def _keys(buckets: int):
    """(part, bucket, keys, times): the sorted keys of a part's windows that fall in a bucket, packed, and in how many."""
    names, types = ["part", "bucket", "keys", "times"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _searched(left, right)
        held = [runs(*joined(b.column("bytes")))[3] for b in slices(iter(left.combine_chunks().to_batches()), "bytes")]
        key, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, times = key[order], np.minimum(times[order], 1 << 30).astype(np.uint32)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        part = left.column("part")[0].as_py() if left.num_rows else 0
        blob = lambda x: [x[cuts[i] : cuts[i + 1]].tobytes() for i in some]
        return pa.table([pa.array(c, t) for c, t in zip(([part] * len(some), some, blob(key), blob(times)), types)], names)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket: for each part its keys found twice or more in the corpus, and which of them are in many windows."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    times = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("times")]).astype(np.int64)
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=times)[back]
    cuts = np.cumsum([0] + [len(k) for k in keys])
    rows = []
    for part, key, a, b in zip(table.column("part").to_pylist(), keys, cuts[:-1], cuts[1:]):
        own = total[a:b]
        if (own > 1).any():
            rows.append((part, key[own > 1].tobytes(), (own[own > 1] > MANY).tobytes()))
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["part", "keys", "many"])


def _known(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    blobs = [x for x in right.column("keys").to_pylist() if x is not None]
    if not blobs:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])
    many = np.concatenate([np.frombuffer(x, bool) for x in right.column("many").to_pylist() if x is not None])
    order = np.argsort(keys, kind="stable")
    return keys[order], many[order]


def _in_part(left: pa.Table, shared: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(bytes, starts, ids, windows) of the slices of a part."""
    for b in slices(iter(left.combine_chunks().to_batches()), "bytes", SLICE_BYTES):
        data, starts = joined(b.column(b.schema.get_field_index("bytes")))
        yield data, starts, b.column(b.schema.get_field_index("id")).to_numpy(), windows(data, starts, shared, many)


def _least(keys: np.ndarray, content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, content) pairs: order of all rows, first row of each pair in it, and each pair's least id."""
    order = np.lexsort((ids, content, keys))
    k, c = keys[order], content[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else order
    return order, new, ids[order][new]


def _distinct_windows(left: pa.Table, right: pa.Table) -> pa.Table:
    """The different windows of a part, each with the least id that has it."""
    shared, many = _known(right)
    left = _searched(left, right)
    kept: list[tuple] = []
    texts: list[bytes] = []
    for data, _, ids, (text, at, own, key, content) in _in_part(left, shared, many) if len(shared) else ():
        order, new, least = _least(key, content, ids[text])
        first = order[new]
        kept.append((key[first], content[first], own[first], least))
        raw = data.tobytes()
        texts += [raw[a:b] for a, b in zip(at[first].tolist(), (at[first] + own[first] + LENGTH - 1).tolist())]
    names = ["part", "key", "content", "own", "least", "window"]
    if not texts:
        return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names)
    key, content, own, least = (np.concatenate(x) for x in zip(*kept))
    order, new, least = _least(key, content, least)
    first = order[new]
    part = left.column("part")[0].as_py()
    return pa.table([pa.array(np.full(len(first), part)), pa.array(key[first].view(np.int64)), pa.array(content[first].view(np.int64)),
                     pa.array(own[first], pa.int32()), pa.array(least), pa.array([texts[i] for i in first.tolist()], pa.binary())], names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by key -> (part, key, content, mask): which strings of a window a smaller id has than the part's least."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        data, starts = joined(table.column("window").combine_chunks())
        own, least = table.column("own").to_numpy().astype(np.int64), table.column("least").to_numpy()
        found = suffix.least_of_equal(data, np.diff(starts), own, least, LENGTH)
        first = np.cumsum(own) - own
        smaller = found < np.repeat(least, own)
        bit = np.left_shift(np.uint64(1), (np.arange(len(found)) - np.repeat(first, own)).astype(np.uint64))
        mask = np.add.reduceat(np.where(smaller, bit, np.uint64(0)), first)
        some = np.flatnonzero(mask)
        if len(some):
            pick = table.select(["part", "key", "content"]).take(pa.array(some)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*pick.columns, pa.array(mask[some].view(np.int64))], ["part", "key", "content", "mask"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        if size > CHUNK_BYTES:  # all but the last key, which may go on
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from done(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        for at in range(0, b.num_rows, 8192):
            part = b.slice(at, 8192)
            held.append(part)
            size += part.get_total_buffer_size() * part.num_rows // max(b.num_rows, 1) if at == 0 else part.nbytes
            if size > 2 * CHUNK_BYTES:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from done(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        yield from done(pa.Table.from_batches(held))


CUT = "part long, id long, sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cutter(keep: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cuts a part's texts.  A window of a larger id than the part's least for it goes whole, that of the least goes by its mask."""
        left = _searched(left, right)
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        shared, many = _known(right)
        marks = right.filter(right.column("mask").is_valid())
        mark_key, mark_content = (marks.column(c).to_numpy().view(np.uint64) for c in ("key", "content"))
        mask = marks.column("mask").to_numpy().view(np.uint64)
        by = np.lexsort((mark_content, mark_key))
        mark = mix(mark_key[by] ^ mix(mark_content[by]))
        mark_order = np.argsort(mark, kind="stable")
        mark, mask = mark[mark_order], mask[by][mark_order]
        found = [(d, s, i, w) for d, s, i, w in _in_part(left, shared, many)]
        least = {}
        if found:
            keys, contents = (np.concatenate([w[k] for *_, w in found]) for k in (3, 4))
            ids = np.concatenate([i[w[0]] for _, _, i, w in found])
            order, new, low = _least(keys, contents, ids)
            pair = np.empty(len(order), np.int64)
            pair[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            least = low[pair] if len(order) else low
        out, done = [], 0
        for data, starts, ids, (text, at, own, key, content) in found:
            low = least[done : done + len(at)]
            done += len(at)
            bits = np.zeros(len(at), np.uint64)
            if len(mark) and len(at):
                name = mix(key ^ mix(content))
                where = np.minimum(np.searchsorted(mark, name), len(mark) - 1)
                bits = np.where(mark[where] == name, mask[where], np.uint64(0))
            whole = ids[text] > low
            bits = np.where(whole, np.left_shift(np.uint64(1), own.astype(np.uint64)) - np.uint64(1), bits)
            some = np.flatnonzero(bits)
            n = own[some]
            row = np.repeat(some, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gone = at[row][(bits[row] >> k.astype(np.uint64)) & np.uint64(1) == 1] + k[(bits[row] >> k.astype(np.uint64)) & np.uint64(1) == 1]
            depth = np.bincount(gone, minlength=len(data) + 1) - np.bincount(gone + LENGTH, minlength=len(data) + 1)[: len(data) + 1] if len(gone) else np.zeros(len(data) + 1, np.int64)
            removed = np.cumsum(depth[: len(data)]) > 0
            for r in range(len(ids)):
                a, e = int(starts[r]), int(starts[r + 1])
                cut = removed[a:e]
                n_cut = int(cut.sum())
                rest = data[a:e][~cut].tobytes() if n_cut else data[a:e].tobytes()
                spans = int(cut[0]) + int(np.count_nonzero(cut[1:] & ~cut[:-1])) if n_cut else 0
                out.append((e - a, n_cut, spans, hashlib.sha256(rest).hexdigest(), rest if keep else None))
        columns = list(zip(*out))
        return pa.table([left.column("part"), left.column("id"), left.column("sha"), *(pa.array(c, t) for c, t in zip(columns, types[3:]))], names)

    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["part", "id", "sha", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return run


def _numbered(spark: SparkSession, count: int) -> DataFrame:
    """(slot, part): part numbers for the slots from 0 to ``count`` - 1 that Spark's bucketing puts into a bucket
    each.  Consecutive numbers would leave some buckets empty and give others several parts."""
    some = spark.range(math.ceil(count * (math.log(count) + 12)))
    return some.groupBy(F.pmod(F.hash("id"), F.lit(count)).cast("long").alias("slot")).agg(F.min("id").alias("part"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document row: (id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    ``kept`` holds the remaining bytes (null if ``keep_text`` is false), which may cut a character; ``n_spans`` counts
    maximal removed runs.  Texts shorter than ``LENGTH`` bytes, null and empty
    ones lose nothing.  Matches never cross texts, and all are judged on the
    input.  Rows of one id never remove each other's bytes, so repeated rows give equal rows; a null id counts
    as larger than all others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), as_bytes(text_col).alias("bytes"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("bytes", 256)))
    total = rows.agg(F.coalesce(F.sum(F.length("bytes").cast("long")), F.lit(0))).first()[0]
    # the texts in parts, once: every later step finds its part in place.  A part has no key of the
    # data, so no text, id or source makes one larger than the others; rows without an id are one row per text.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = max(tasks, math.ceil(total / PART_BYTES))
    slot = F.pmod(F.xxhash64("id", "sha"), F.lit(count).cast("long"))
    numbers = stages.put(_numbered(spark, count).coalesce(1)) if count <= MOST_BUCKETS else None

    def dealt(df: DataFrame) -> DataFrame:
        if numbers is None:  # many parts a bucket, so that they even out
            return df.withColumn("part", slot)
        found = df.withColumn("slot", slot).join(F.broadcast(numbers), "slot", "left")  # at most MOST_BUCKETS rows
        return found.withColumn("part", F.coalesce("part", "slot")).drop("slot")

    least = stages.put(dealt(keyed.groupBy("sha").agg(F.min("id").alias("id"))).select("part", "id", "sha"))
    no_id = keyed.where("doc is null").groupBy("id", "sha").agg(F.first("bytes").alias("bytes"))
    texts = keyed.where("doc is not null").select("id", "sha", "bytes").unionByName(no_id)
    parts = stages.bucketed(dealt(texts).select("part", "id", "sha", "bytes"), "part", min(count, MOST_BUCKETS))
    stages.release()
    parted = parts.groupBy("part")
    buckets = max(32, math.ceil(total / BUCKET_BYTES))
    keys = parted.cogroup(least.groupBy("part")).applyInArrow(_keys(buckets), "part long, bucket int, keys binary, times binary")
    shared = stages.put(keys.repartition(max(tasks, buckets), "bucket").groupBy("bucket").applyInArrow(_shared, "part long, keys binary, many binary"))
    stages.release()
    right = least.unionByName(shared, allowMissingColumns=True)
    found = parted.cogroup(right.groupBy("part")).applyInArrow(
        _distinct_windows, "part long, key long, content long, own int, least long, window binary")
    marks = stages.put(found.repartition(max(tasks, math.ceil(total / KEY_BYTES)), "key").sortWithinPartitions("key").mapInArrow(_compare, "part long, key long, content long, mask long"))
    stages.release()
    first = stages.put(parted.cogroup(right.unionByName(marks, allowMissingColumns=True).groupBy("part")).applyInArrow(_cutter(keep_text), CUT))
    stages.drop(parts, shared, marks, least, *([numbers] if numbers is not None else []))
    stages.release()
    first = first.withColumnsRenamed({"id": "first_id", "n_bytes": "first_bytes"})
    every = keyed.select("doc", "id", "sha", F.length("bytes").cast("long").alias("n_bytes"))
    out = every.join(first, "sha")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)  # every string of it starts in the first text too
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("doc").alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy & F.lit(keep_text), F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"))
