"""Benchmark decontamination: rare n-gram seeds, then local alignment (operator 10).

Test items come in blocks of bounded size, and each block is shared with all
tasks; the training texts are never shuffled.  A first pass counts the word
n-grams of the items over all texts.  Seeds are those that occur at most
``rare`` times, and those at most ``NEAR`` times as frequent as the item's
``KEEP`` rarest present ones: a much copied item keeps all its n-grams, one
with everyday n-grams loses these.  N-grams that occur nowhere are no seeds and
do not count as rarest.  A second pass finds the seeds in each document; seeds
whose positions imply the same alignment make one candidate passage.  Candidates
that hold too few of the item's words to reach the score are dropped, and
Smith-Waterman over words scores the others against the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, PLAIN_WORDS, as_bytes, joined, mix, slices, unused, windows_hash, words

NGRAM = 3
RARE, KEEP, NEAR = 1024, 4, 4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1 << 20  # words of test items shared with all tasks at a time
ALIGN_CELLS = 1 << 18
FOUND_ROWS = 1 << 20  # seeds found in a slice of texts that are held at a time, and words of passages


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of test items: (item id by word, word hash).  An item longer than a block is a block of its own."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes")).where("id is not null")
    ids, hashes, held = [], [], 0
    for r in rows.toLocalIterator():
        h = words(*_one(bytes(r["bytes"])), PLAIN_WORDS)[3]
        if held and held + len(h) > BLOCK_WORDS:
            yield np.concatenate(ids), np.concatenate(hashes)
            ids, hashes, held = [], [], 0
        # repeated rows and repeated ids are items of their own that report under one id
        ids.append(np.full(len(h), r["id"], np.int64))
        hashes.append(h)
        if len(h):
            ids.append(np.array([r["id"]], np.int64))  # the end of an item
            hashes.append(np.zeros(1, np.uint64))
        held += len(h) + 1
    if held:
        yield np.concatenate(ids), np.concatenate(hashes)


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64)


class Block:
    """Items of a block with their n-grams."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray):
        ends = np.flatnonzero(hashes == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.ids = ids[starts] if len(starts) else np.zeros(0, np.int64)
        self.words = [hashes[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        grams, item, place = [], [], []
        for k, w in enumerate(self.words):
            n = min(NGRAM, len(w))
            g = windows_hash(w, n)
            grams.append(g)
            item.append(np.full(len(g), k, np.int64))
            place.append(np.arange(len(g)))
        none = np.zeros(0, np.int64)
        self.gram = np.concatenate(grams) if grams else none.astype(np.uint64)
        self.item, self.place = (np.concatenate(x) if x else none for x in (item, place))
        self.lengths = sorted({min(NGRAM, len(w)) for w in self.words})

        own = [np.unique(_own(w, k), return_counts=True) for k, w in enumerate(self.words)]
        bag = np.concatenate([x for x, _ in own]) if own else none.astype(np.uint64)
        order = np.argsort(bag, kind="stable")
        self.bag = bag[order]  # the words of each item, and how often each is in it
        self.times = np.concatenate([n for _, n in own])[order] if own else none

    def seeds(self) -> Seeds:
        """Every n-gram of every item."""
        order = np.argsort(self.gram, kind="stable")
        return Seeds(self.gram[order], self.item[order], self.place[order], self)

    def rare_seeds(self, known: np.ndarray, times: np.ndarray, rare: int) -> Seeds:
        """The n-grams that occur, at most ``rare`` times or little more often than the rarest of their item; ``known`` is sorted."""
        n = np.zeros(len(self.gram), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, self.gram), len(known) - 1)
            n = np.where(known[place] == self.gram, times[place], 0)
        limit = np.full(len(self.words), rare, np.int64)
        there = np.flatnonzero(n)
        order = there[np.lexsort((n[there], self.item[there]))]
        own, first, size = np.unique(self.item[order], return_index=True, return_counts=True)
        limit[own] = np.maximum(rare, NEAR * n[order[first + np.minimum(KEEP, size) - 1]])
        some = np.flatnonzero((n > 0) & (n <= limit[self.item]))
        some = some[np.argsort(self.gram[some], kind="stable")]
        return Seeds(self.gram[some], self.item[some], self.place[some], self)


def _own(h: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    """Hash of a word as one of an item's."""
    with np.errstate(over="ignore"):
        return mix(h + np.asarray(item, np.uint64) * MULT)


class Seeds:
    def __init__(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray, block: Block):
        self.gram, self.item, self.place, self.block = gram, item, place, block
        self.maybe = _maybe(gram)


def _maybe(gram: np.ndarray) -> np.ndarray:
    """A small table by the low bits of a hash: False where none of ``gram`` can be."""
    table = np.zeros(1 << 22, bool)
    table[(gram & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return table


def _grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of joined texts and the word each begins at, none across two texts."""
    g = windows_hash(h, n)
    inside = row[: len(g)] == row[n - 1 : n - 1 + len(g)]
    return g[inside], np.flatnonzero(inside)


def _found(g: np.ndarray, at: np.ndarray, known: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the n-grams that are among the sorted ``known``."""
    hit = np.flatnonzero(maybe[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
    g, at = g[hit], at[hit]
    if not len(g) or not len(known):
        return at[:0], g[:0]
    same = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
    return at[same], g[same]


def candidates(seeds: Seeds, h: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
    """Rows (text, item, first word, word after the last): passages that an item may align with, some items at a time."""
    hits = [_found(*_grams(h, row, n), seeds.gram, seeds.maybe) for n in seeds.block.lengths]
    at, g = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if not len(g):
        return
    size = np.array([len(w) for w in seeds.block.words])
    each, n = np.unique(g, return_counts=True)
    often = np.zeros(len(seeds.gram) + 1, np.int64)
    often[np.searchsorted(seeds.gram, each, side="left")] += n
    often[np.searchsorted(seeds.gram, each, side="right")] -= n
    often = np.cumsum(often)[:-1]
    of_item = np.cumsum(np.bincount(seeds.item, weights=often, minlength=len(size)).astype(np.int64))
    low = 0
    while low < len(size):
        done = of_item[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(of_item, done + FOUND_ROWS, side="right")))
        some = np.flatnonzero((often > 0) & (seeds.item >= low) & (seeds.item < high))
        low = high
        gram = seeds.gram[some]
        left = np.searchsorted(gram, g, side="left")
        many = np.searchsorted(gram, g, side="right") - left
        which = some[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        found = np.column_stack([row[np.repeat(at, many)], seeds.item[which], np.repeat(at, many) - seeds.place[which]])
        if not len(found):
            continue
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        slack = size[found[:, 1]] // 2 + 2
        same = np.all(found[1:, :2] == found[:-1, :2], axis=1) & (found[1:, 2] - found[:-1, 2] <= slack[1:])
        new = np.concatenate([[0], np.flatnonzero(~same) + 1])
        last = np.concatenate([new[1:], [len(found)]]) - 1
        first_word, after = np.searchsorted(row, found[new, 0]), np.searchsorted(row, found[new, 0], side="right")
        yield np.column_stack([found[new, 0], found[new, 1], np.maximum(first_word, found[new, 2] - slack[new]),
                               np.minimum(after, found[last, 2] + size[found[new, 1]] + slack[new])])


def _enough(block: Block, h: np.ndarray, found: np.ndarray, min_score: float) -> np.ndarray:
    """Which candidates hold the share ``min_score`` of their item's words in any order: no alignment of the others reaches it."""
    least = np.array([len(w) for w in block.words])[found[:, 1]] * min_score - 1e-6
    length = found[:, 3] - found[:, 2]
    before = np.concatenate([[0], np.cumsum(length)])
    out, a = np.zeros(len(found), bool), 0
    while a < len(found):
        b = max(a + 1, int(np.searchsorted(before, before[a] + FOUND_ROWS, side="right")) - 1)
        which = np.repeat(np.arange(b - a), length[a:b])
        at = np.arange(len(which)) - (before[a:b] - before[a])[which] + found[a:b, 2][which]
        key = _own(h[at], found[a:b, 1][which])
        place = np.minimum(np.searchsorted(block.bag, key), len(block.bag) - 1)
        mine = block.bag[place] == key
        pairs = np.unique(which[mine] * len(block.bag) + place[mine])
        held = np.bincount(pairs // len(block.bag), weights=block.times[pairs % len(block.bag)], minlength=b - a)
        out[a:b] = held >= least[a:b]
        a = b
    return out


def align(item: np.ndarray, passages: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of ``item`` against each passage (word hashes)."""
    width = max(map(len, passages))
    text = np.zeros((len(passages), width), np.uint64)  # 0 stands for no word
    for k, p in enumerate(passages):
        text[k, : len(p)] = p
    best = np.zeros(len(passages), np.int64)
    above = np.zeros((len(passages), width + 1), np.int64)
    slope = -GAP * np.arange(width + 1)
    for w in item:
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + np.where(text == w, MATCH, MISMATCH), above[:, 1:] + GAP))
        # a gap along the passage: the best of all cells to the left, less the way from there
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        best = np.maximum(best, here.max(axis=1))
        above = here
    return best


def scores(seeds: Seeds, h: np.ndarray, row: np.ndarray, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, word after the last) of every passage that reaches ``min_score``; a full copy scores 1."""
    return [x for found in candidates(seeds, h, row) for x in _scored(seeds, h, found[_enough(seeds.block, h, found, min_score)]) if x[2] >= min_score]


def _scored(seeds: Seeds, h: np.ndarray, found: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    found = found[np.argsort(found[:, 1], kind="stable")]
    out = []
    cuts = np.flatnonzero(np.diff(found[:, 1], prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        item = seeds.block.words[found[a, 1]]
        at = a
        while at < b:
            to, width = at, 0
            while to < b and (to == at or max(width, found[to, 3] - found[to, 2]) * (to - at + 1) <= ALIGN_CELLS):
                width = max(width, found[to, 3] - found[to, 2])
                to += 1
            got = align(item, [h[x[2] : x[3]] for x in found[at:to]])
            out += [(int(x[0]), int(x[1]), s / (MATCH * len(item)), int(x[2]), int(x[3])) for x, s in zip(found[at:to], got.tolist())]
            at = to
    return out


def _seeded(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, rare: int) -> Iterator[Seeds]:
    """The seeds of each block of items; ``rows`` has the texts as ``bytes``."""
    for ids, hashes in _items(items, item_id, item_text):
        block = Block(ids, hashes)
        shared = rows.sparkSession.sparkContext.broadcast(block.seeds())

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros(len(own.gram), np.int64)  # at the first place of each n-gram
            for b in slices(batches, "bytes"):
                data, starts = joined(b.column("bytes"))
                _, _, row, h = words(data, starts, PLAIN_WORDS)
                for n in own.block.lengths:
                    g = _found(*_grams(h, row, n), own.gram, own.maybe)[1]
                    np.add.at(total, np.searchsorted(own.gram, g), 1)
            seen = np.flatnonzero(total)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(own.gram[seen].view(np.int64)), pa.array(total[seen])], ["gram", "n"])

        counts = rows.select("bytes").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most a block's n-grams
        gram = counts.column("gram").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(gram)
        yield block.rare_seeds(gram[order], counts.column("n").to_numpy()[order], rare)
        shared.destroy()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", min_score: float = 0.5, rare: int = RARE) -> DataFrame:
    """One row per document row and test item whose best alignment scores at least
    ``min_score``: (id, item_id, score, n_passages, start_word, end_word).

    The score is the Smith-Waterman score over the score of a full copy;
    ``start_word`` and ``end_word`` bound the searched passage around the best
    alignment, ``n_passages`` counts the passages that reach the score.  Words are runs of letters
    and digits in ASCII lower case.  A passage must share a run of
    ``NGRAM`` words with the item that is rare among the texts (module docstring).  Null and empty texts match nothing; items
    without words or id are skipped; items of fewer than three words must match
    by all their words' run.  Repeated rows each give their rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes"))
    schema = "id long, item_id long, score double, n_passages int, start_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for seeds in _seeded(rows, items, item_id, item_text, rare):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches, "bytes"):
                data, starts = joined(b.column("bytes"))
                _, _, row, h = words(data, starts, PLAIN_WORDS)
                best: dict[tuple[int, int], list] = {}
                for text, item, score, first, last in scores(own, h, row, min_score):
                    offset = int(np.searchsorted(row, text))
                    key, here = (text, int(own.block.ids[item])), [score, 1, first - offset, last - offset]
                    if key in best:
                        old = best[key]
                        here = (here if score > old[0] else old)[:1] + [old[1] + 1] + (here if score > old[0] else old)[2:]
                    best[key] = here
                ids = b.column("id")
                table = [(ids[text].as_py(), item, *x) for (text, item), x in sorted(best.items())]
                if table:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), (
                        pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()))], [x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          min_score: float = 0.5, rare: int = RARE) -> DataFrame:
    """The rows of ``docs`` that hold no test item (see ``contamination``), columns unchanged,
    whatever their names.  A null text holds none; rows that repeat are judged alike; empty
    tables give empty ones, and without items every row stays."""
    spark = docs.sparkSession
    schema, names = docs.schema, docs.columns
    text = unused("__bytes", names)
    for seeds in _seeded(docs.select(as_bytes(text_col).alias("bytes")), items, item_id, item_text, rare):
        shared = spark.sparkContext.broadcast(seeds)
        keyed = docs.withColumn(text, as_bytes(text_col))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in slices(batches, text):
                data, starts = joined(b.column(b.schema.get_field_index(text)))
                _, _, row, h = words(data, starts, PLAIN_WORDS)
                bad = {i for i, *_ in scores(own, h, row, min_score)}
                keep = [i for i in range(b.num_rows) if i not in bad]
                if keep:
                    yield b.select(list(range(len(names)))).take(pa.array(keep))

        docs = keyed.mapInArrow(run, schema)
    return docs
