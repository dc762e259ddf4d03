"""Repeated sentence spans (operator 9).

A text is cut into sentences; one of more than ``MOST_WORDS`` words counts as
several, cut behind its commas, semicolons and colons.  A clause that is still
longer is cut before words chosen by their hash: the least hash of every
``WINDOW`` words, so that a passage has the same cuts wherever it stands, but
for less than a window at its ends.  In scripts without spaces the characters
count: two of Han or kana are a word, four of Thai and its like; the sentence
marks of such scripts end a sentence whatever follows them.  From each piece
on, the shortest run of consecutive pieces is hashed to 128 bits that holds the
ends of ``run`` sentences or clauses and ``MIN_WORDS`` words, or two pieces and
``LONG_WORDS`` words; so are the shortest ones up to the ends of the text and of
cut clauses.  Runs are grouped over the whole table, and pieces covered
by any occurrence of a repeated run but the first are removed.  First is the
least (id, row, place), rows without id last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, as_bytes, slices

MOST_WORDS = 20
MIN_WORDS = 10
LONG_WORDS = 24
WINDOW = 12
_END = re.compile(r"[.!?]+(?=\s)\s*|\n\s*")
_CLAUSE = re.compile(r"[,;:]\s+")
_WORD = re.compile(r"\S+")
#: Scripts written without spaces: Han and kana; Thai, Lao, Tibetan, Burmese, Khmer.
_HAN = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_THAI = "\u0e01-\u0fff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_HAN}{_THAI}]")
_TOKEN = re.compile(rf"[{_HAN}{_THAI}]|[^\s{_HAN}{_THAI}]+")
_UNITS = re.compile(rf"(?:[{_HAN}]{{1,2}}|[{_THAI}]{{1,4}})[、，；：。！？｡」』”’）》〉】]*|[^\s{_HAN}{_THAI}]+")
#: The same ends and clauses with the marks of other scripts; white space between characters of unspaced scripts parts clauses.
_WIDE_END = re.compile(_END.pattern + r"|[。！？｡।॥؟۔።။។]+[」』”’）》〉】]*\s*")
_WIDE_CLAUSE = re.compile(_CLAUSE.pattern + rf"|[、，；：､،؛]\s*|(?<=[{_HAN}{_THAI}])\s+")


def _words(text: str) -> list[str]:
    return text.split() if text.isascii() or not _UNSPACED.search(text) else _UNITS.findall(text)


def pieces(text: str) -> list[tuple[int, int, list[str], bool]]:
    """(start, end, words, whether a sentence or clause ends with it) of each piece, white space after it included; those without words join the one before."""
    out: list[tuple[int, int, list[str], bool]] = []
    ends = [m.end() for m in (_END if text.isascii() else _WIDE_END).finditer(text)]
    start = 0
    for end in [*ends, len(text)]:
        own = _words(text[start:end])
        if not own:
            if out and end > start:
                out[-1] = (out[-1][0], end, *out[-1][2:])
                start = end
            continue
        if len(own) > MOST_WORDS:
            out += _clauses(text, start, end)
        else:
            out.append((start, end, own, True))
        start = end
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each piece."""
    return [x[:3] for x in pieces(text)]


def _clauses(text: str, start: int, end: int) -> list[tuple[int, int, list[str], bool]]:
    """The clauses of a long sentence; where one is cut does not depend on what stands in the others."""
    out = []
    cuts = [start, *(start + m.end() for m in (_CLAUSE if text.isascii() else _WIDE_CLAUSE).finditer(text[start:end])), end]
    for a, b in zip(cuts, cuts[1:]):
        own = _words(text[a:b])
        if not own:
            if out and b > a:
                out[-1] = (out[-1][0], b, *out[-1][2:])
            continue
        if len(own) <= MOST_WORDS:
            out.append((a, b, own, True))
            continue
        inner = [a, *_places(text, a, b), b]
        parts = [(x, y, _words(text[x:y])) for x, y in zip(inner, inner[1:])]
        out += [(*p, p[1] == b) for p in parts]
    return out


def _places(text: str, a: int, b: int) -> list[int]:
    """Where a long clause is cut: before the token that, with the next one, has the least hash of a window, the first of equals."""
    found = list((_WORD if text.isascii() else _TOKEN).finditer(text, a, b))
    low = [m.group().lower().encode("utf-8", "surrogatepass") for m in found]
    h = [xxhash.xxh64_intdigest(w + b" " + v) for w, v in zip(low, [*low[1:], b""])]
    out, best = [], -1
    for last in range(min(WINDOW, len(h)) - 1, len(h)):
        first = max(0, last - WINDOW + 1)
        if best < first:
            best = min(range(first, last + 1), key=h.__getitem__)
        elif h[last] < h[best]:
            best = last
        else:
            continue
        if best:
            out.append(found[best].start())
    return out


def _is_run(part: list[tuple[int, int, list[str], bool]], run: int) -> bool:
    held = sum(len(p[2]) for p in part)
    return held >= MIN_WORDS and sum(p[3] for p in part) >= run or held >= LONG_WORDS and len(part) >= 2


def runs_of(parts: list[tuple[int, int, list[str], bool]], run: int) -> list[tuple[int, int]]:
    """(first piece, piece after the last): the shortest run from each piece, then the shortest ones up to the ends of
    the text and of clauses that were cut, where no other ends there."""
    out, end, held, closed = [], 0, 0, 0
    for i in range(len(parts)):
        while end < len(parts) and not (closed >= run and held >= MIN_WORDS or end - i >= 2 and held >= LONG_WORDS):
            held += len(parts[end][2])
            closed += parts[end][3]
            end += 1
        if not (closed >= run and held >= MIN_WORDS or end - i >= 2 and held >= LONG_WORDS):
            break
        out.append((i, end))
        held -= len(parts[i][2])
        closed -= parts[i][3]
    known = {e for _, e in out}
    for k in range(1, len(parts)):
        if (k == len(parts) - 1 or parts[k][3] and not parts[k - 1][3]) and k + 1 not in known:
            first = k
            while first and not _is_run(parts[first : k + 1], run):
                first -= 1
            if _is_run(parts[first : k + 1], run):
                out.append((first, k + 1))
    return out


def run_hashes(parts: list[tuple[int, int, list[str], bool]], run: int) -> list[bytes]:
    """A 128-bit hash of each run of pieces, case ignored."""
    lines = [" ".join(p[2]).lower() for p in parts]
    return [xxhash.xxh3_128_digest("\n".join(lines[i:end]).encode("utf-8", "surrogatepass")) for i, end in runs_of(parts, run)]


def _cut(docs: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches, "bytes"):
            texts = [t.decode("utf-8", "replace") for t in b.column("bytes").to_pylist()]
            runs, sizes = [], []
            for t in texts:
                parts = pieces(t)
                runs.append(run_hashes(parts, run))
                sizes.append(len(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(texts)), pa.int64()), b.column("id"), pa.array(texts), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.binary()))],
                ["row", "id", "text", "n_sentences", "runs"])
            row += len(texts)

    return rows.mapInArrow(work, "row long, id long, text string, n_sentences long, runs array<binary>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3) -> DataFrame:
    """One row per document row: (id, text, n_sentences, n_removed, n_spans).

    ``text`` is what remains, ``n_spans`` the number of maximal removed runs of
    sentences.  A run that repeats inside one text is removed there too.  Null
    and empty texts give empty ones; rows that repeat are texts of their own,
    and those without id come after all others.  An empty table gives no rows.
    Other columns are not read.
    """
    stages = Stages(docs.sparkSession, "spans")
    whole = stages.put(_cut(docs, id_col, text_col, run))
    runs = whole.select("row", "id", F.posexplode("runs").alias("place", "hash"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "place")
    first = stages.put(runs.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(
        "hash", F.col("first.row").alias("first_row"), F.col("first.place").alias("first_place")))
    later = runs.join(first, "hash").where("row <> first_row or place <> first_place")
    marks = stages.put(later.groupBy("row").agg(F.collect_set("place").alias("places")))  # bounded by the text's length
    stages.drop(first)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            out = []
            for text, size, places in zip(b.column("bytes").to_pylist(), b.column("n_sentences").to_pylist(), b.column("places").to_pylist()):
                text = text.decode("utf-8", "replace")
                if not places:
                    out.append((text, size, 0, 0))
                    continue
                parts = pieces(text)
                own = runs_of(parts, run)
                gone = {k for p in places for k in range(*own[p])}
                kept = "".join(text[a:e] for i, (a, e, *_) in enumerate(parts) if i not in gone)
                out.append((kept, size, len(gone), sum(i - 1 not in gone for i in gone)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64())))],
                ["id", "text", "n_sentences", "n_removed", "n_spans"])

    # hashed by row at every size: no broadcast of small inputs only, and no sort of the texts
    marked = whole.join(marks.hint("shuffle_hash"), "row", "left").select("id", F.col("text").cast("binary").alias("bytes"), "n_sentences", "places")
    return marked.mapInArrow(remove, "id long, text string, n_sentences long, n_removed long, n_spans long").withColumnRenamed("id", id_col)
