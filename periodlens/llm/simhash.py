"""SimHash near-duplicates by pigeonhole blocks (operator 8).

A fingerprint has 64 bits in six blocks.  Two fingerprints that differ in at
most three bits agree on at least three whole blocks, so they share one of the
20 block triples.  Fingerprints are grouped by triple (about 32 bits, so chance
meetings are rare at any size), and the Hamming distance is verified inside a
group.  A group gives one link per member only, never its pairs.
Groups above ``GROUP`` members are split anew on the bits that the triple left
open; after the third split a group has at most 2**9 members, so no group is
unbounded and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, as_bytes, slices, unused
from .components import components

GROUP = 1024
LEVELS = 3
SEED = 42


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """SimHash of one text: 0 if it has no words; the whole sequence is the only shingle of a shorter text."""
    w = text.lower().split()  # ASCII lower case and ASCII white space, as bytes
    if not w:
        return 0
    n = shingle_words
    if len(w) <= n:
        shingles = [b" ".join(w)]
    else:
        shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(shingles), 1 << 15):
        h = np.array([digest(s, SEED) for s in shingles[i : i + (1 << 15)]], np.uint64)
        ones += np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """(id, content hash, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("content"), as_bytes(text_col).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            fp = np.array([fingerprint(t, shingle_words) for t in b.column("bytes").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("content"), pa.array(fp)], ["id", "content", "fp"])

    return rows.mapInArrow(run, "id long, content long, fp long")


def block_masks(bits: int, max_bits: int) -> list[int]:
    """Masks of the block combinations that any two values within ``max_bits`` must share, over the set bits of ``bits``."""
    places = [i for i in range(64) if bits >> i & 1]
    parts = min(max_bits + 3, len(places)) or 1
    blocks = [sum(1 << int(p) for p in part) for part in np.array_split(places, parts)] if places else []
    return [sum(c) for c in combinations(blocks, max(0, parts - max_bits))] or [0]


def _level_masks(level: int, max_bits: int) -> list[int]:
    """Mask by group kind: kinds of a level are numbered parent * fan-out + child."""
    masks = [0]
    for _ in range(level):
        fan = len(block_masks(~0 & (1 << 64) - 1, max_bits))
        grown = []
        for m in masks:
            own = [] if m is None else [m | x for x in block_masks(~m & (1 << 64) - 1, max_bits)]
            grown += own + [None] * (fan - len(own))
        masks = grown
    return masks


def _keyed(level: int, max_bits: int):
    """Rows (fp, kind of the level above) -> one row per block combination of this level."""
    masks = _level_masks(level, max_bits)
    fan = len(block_masks((1 << 64) - 1, max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                fp, kind = part.column("fp").to_numpy(), part.column("kind").to_numpy()
                for k in np.unique(kind).tolist():
                    own = fp[kind == k]
                    for child in range(k * fan, (k + 1) * fan):
                        if masks[child] is not None:
                            value = own & np.array([masks[child]], np.uint64).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), child, np.int64)), pa.array(value)], ["fp", "kind", "value"])

    return run


def forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of each connected part of the graph of values at most ``max_bits`` bits apart: from its first value to every other."""
    links, left = [], np.arange(len(fp))
    while len(left) > 1:
        first, edge, left = left[0], left[:1], left[1:]
        while len(edge) and len(left):
            near = np.bitwise_count(fp[left] ^ fp[edge[0]]) <= max_bits
            found = left[near]
            links += [(int(fp[first]), int(x)) for x in fp[found]]
            edge, left = np.concatenate([edge[1:], found]), left[~near]
    return links


def _linker(max_bits: int, last: bool):
    """Rows sorted by (kind, value) -> links (a, b), and members (a, kind) of groups that are too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        huge = None  # key of a group whose members pass through
        for b in _ended(batches):
            if b is not None:
                held = np.concatenate([held, np.column_stack([b.column(c).to_numpy() for c in ("kind", "value", "fp")])])
            links, over = [], []
            if len(held):
                new = np.flatnonzero(np.any(held[1:, :2] != held[:-1, :2], axis=1)) + 1
                cuts = np.concatenate([[0], new, [len(held)]])
                groups = len(cuts) - 1 - (b is not None)  # the last one may go on in the next batch
                lengths = np.diff(cuts)[:groups]
                two = cuts[:groups][lengths == 2]
                if huge is not None and groups and tuple(held[0, :2]) == huge:
                    two = two[two != 0]
                if len(two):
                    near = np.bitwise_count(held[two, 2].view(np.uint64) ^ held[two + 1, 2].view(np.uint64)) <= max_bits
                    links += list(zip(held[two[near], 2].tolist(), held[two[near] + 1, 2].tolist()))
                for g in np.flatnonzero((lengths > 2) | (cuts[:groups] == 0)).tolist():
                    own = held[cuts[g] : cuts[g + 1]]
                    if huge is not None and tuple(own[0, :2]) == huge or len(own) > GROUP and not last:
                        over += [(x[2], x[0]) for x in own.tolist()]
                    elif len(own) > 2:
                        links += [tuple(np.array(x, np.uint64).view(np.int64).tolist()) for x in forest(own[:, 2].view(np.uint64), max_bits)]
                held = held[cuts[groups] :] if b is not None else held[:0]
                if len(held) and (huge is not None and tuple(held[0, :2]) == huge or len(held) > GROUP and not last):
                    huge = tuple(held[0, :2])
                    over += [(x[2], x[0]) for x in held.tolist()]
                    held = held[:0]
            if links or over:
                a = [x for x, _ in links] + [x for x, _ in over]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array([y for _, y in links] + [None] * len(over), pa.int64()),
                     pa.array([None] * len(links) + [k for _, k in over], pa.int64())], ["a", "b", "kind"])

    return run


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def close_links(values: DataFrame, max_bits: int, stages: Stages) -> DataFrame:
    """``values``: distinct fingerprints (fp).  Links (a, b) that connect exactly the
    fingerprints connected by pairs at most ``max_bits`` bits apart."""
    found, rows = None, values.select("fp", F.lit(0).cast("long").alias("kind"))
    for level in range(1, LEVELS + 1):
        keyed = rows.mapInArrow(_keyed(level, max_bits), "fp long, kind long, value long")
        grouped = keyed.repartition("kind", "value").sortWithinPartitions("kind", "value")
        out = stages.put(grouped.mapInArrow(_linker(max_bits, level == LEVELS), "a long, b long, kind long"))
        links = out.where("b is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = out.where("kind is not null").select(F.col("a").alias("fp"), "kind").distinct()
        if level == LEVELS or rows.isEmpty():
            return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per input row: (id, content, fingerprint, component_id).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    id of the rows connected to this one by fingerprints at most ``max_bits``
    bits apart.  ``content`` is a hash of the text that tells rows of one id
    apart.  Null and empty texts have the fingerprint zero and are linked like
    any other; null ids never win as ``component_id`` unless the whole
    component has none (then it is null).  Repeated rows each give a row.  An
    empty table gives an empty result.  Other columns are not read.
    """
    stages = Stages(docs.sparkSession, "simhash")
    rows = stages.put(fingerprints(docs, id_col, text_col, shingle_words))
    values = stages.put(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    labels = stages.put(components(close_links(values.select("fp"), max_bits, stages), stages))
    named = values.join(labels, values.fp == labels.node).groupBy("label").agg(F.min("least_id").alias("of_label"))
    named = stages.put(named)
    linked = stages.put(labels.join(named, "label").select(F.col("node").alias("fp"), "of_label"))
    # every value whether linked or not, as a table, so that the join below can split a hot fingerprint
    known = stages.put(values.join(linked, "fp", "left").select("fp", F.when(F.col("of_label").isNull(), F.col("least_id")).otherwise(F.col("of_label")).alias("component_id")))
    stages.drop(linked, named, labels, values)
    return rows.join(known, "fp").select(
        F.col("id").alias(id_col), "content", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: that of the
    smallest id (smallest content hash among rows of one id, and of rows equal in
    both that whose columns have the smallest hash).  A row without an id stands for
    its group only if no row of the group has one.  Rows that repeat stay once; an
    empty table gives an empty one.  Columns and their order are kept, whatever their
    names."""
    stages = Stages(docs.sparkSession, "simhash-keep")
    found = stages.put(simhash_components(docs, id_col, text_col, shingle_words, max_bits).withColumnRenamed(id_col, "__id"))
    # the group of a component without ids: its fingerprints have no id to name them, so each fingerprint stands alone
    group = F.when(F.col("component_id").isNull(), F.col("fingerprint")).otherwise(F.col("component_id").cast("string"))
    best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("content").alias("content")))
    names = docs.columns
    keys = [unused(k, names) for k in ("__row_id", "__row_none", "__row_content", "__row_order")]
    many = unused("__row_many", names)
    kept = stages.put(found.groupBy(group.alias("g")).agg(best.alias("best")).select(
        F.coalesce("best.id", F.lit(0)).alias(keys[0]), F.col("best.none").alias(keys[1]), F.col("best.content").alias(keys[2])).distinct())
    row_id = F.col(id_col).cast("long")
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    row = docs.withColumns(dict(zip(keys, (F.coalesce(row_id, F.lit(0)), row_id.isNull(), F.xxhash64(text_col), order))))
    # which rows stay is settled on hashes; whole rows are joined once, and only those that repeat are grouped
    each = row.select(*keys).join(kept, keys[:3], "left_semi").groupBy(*keys).agg(F.count("*").alias(many))
    chosen = stages.put(each.groupBy(*keys[:3]).agg(F.min(F.struct(keys[3], many)).alias("least")).select(*keys[:3], "least.*"))
    stages.drop(found, kept)
    out = row.join(chosen, keys)
    out = out.where(F.col(many) == 1).unionByName(out.where(F.col(many) > 1).dropDuplicates(keys))
    return out.select(*[F.col(f"`{c}`") for c in names])
