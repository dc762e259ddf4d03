"""Personal data: pattern spans and a character BiLSTM-CRF (operator 3).

The base rules find the plain forms.  The tagger is trained on spans that the
base rules label in a bounded sample of rows, and on invented spans, plain and
written around the rules ("at", "dot", missing plus sign, odd separators), set
into text of the sample.  It reads every character of every text in
overlapping windows; spans of neighbouring windows are reconciled per text.  A
found span is added if its digits or names pass the checks of its kind and it
does not touch a base span.  Windows in which no such span can lie are left
out, which changes no result (see ``tag_texts``).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_bytes, slices, unused
from .lstm import PAD, Tagger, char_ids

KINDS = ["email", "ip", "card", "phone"]
#: Rows at most that give windows to the tagger's training, the least hashes first.
TRAIN_ROWS = 400
WINDOW, MARGIN = 256, 16
STRIDE = WINDOW - 2 * MARGIN
BATCH = 2048
TRAIN_WINDOW, TRAIN_WINDOWS, STEPS = 80, 1536, 300

Span = tuple[int, int, int]  # kind, start, end

# -------------------------------------------------------------- base rules
_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Name, @, domain of two labels or more; works from each @, so it is linear in the text."""
    out = []
    if "@" not in text:
        return out
    for run in _RUN.finditer(text):
        at, done = text.find("@", run.start(), run.end()), run.start()
        while at >= 0:
            m = _DOMAIN.match(text, at + 1) if at > done else None
            if m:
                out.append((0, done, m.end()))
            done = m.end() if m else at + 1
            at = text.find("@", done, run.end())
    return out


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def ips(text: str) -> list[Span]:
    """Each four numbers in turn of a chain of numbers joined by dots."""
    out = []
    for chain in _CHAIN.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(map(octet, parts[i : i + 4])):
                out.append((1, at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and then start."""
    return emails(text) + ips(text) + cards(text) + phones(text)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


# --------------------------------------------------- training of the tagger
def invented(rng: random.Random, kind: int) -> str:
    """A made-up span of a kind, in a plain or an evasive form."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
    if kind == 0:
        user = name(2, 8) + rng.choice(["", ".", "_"]) + rng.choice([name(1, 7), n(2)])
        host, end = name(3, 9) + rng.choice(["", n(1)]), rng.choice(["com", "org", "net", "de", "example.com"])
        at, dot = rng.choice([("@", ".")] * 3 + [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", ".")])
        return f"{user}{at}{host}{dot}{end.replace('.', dot)}"
    if kind == 1:
        return rng.choice(["."] * 5 + [" . ", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-", " ", ".", "  ", " - "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(4)}", f"+{n(11)}", f"({n(3)}) {n(3)}-{n(4)}",
                       f"{n(3)}-{n(3)}-{n(4)}", f"00{n(2)} {n(2)} {n(4)} {n(4)}"])


def near_miss(rng: random.Random) -> str:
    """Numbers and names that are no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([f"{n(1)},{n(3)}.{n(2)}", f"19{n(2)}-0{rng.randint(1, 9)}-{n(2)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(2)}:{n(2)}", f"{n(4)}", f"{n(1)}.{n(2)}%",
                       f"#{n(5)}", f"{n(1)}, {n(2)}, {n(2)}, {n(1)}", f"{n(3)}-{n(2)}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"at {n(1)} dot", f"{n(9)}", f"{n(24)}", "CC BY-NC 4.0."])


def tagged(text: str, spans: list[Span], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and tags of a training window; spans cut by its edge keep the tags of their rest."""
    ids, tags = np.full(TRAIN_WINDOW, PAD, np.uint8), np.zeros(TRAIN_WINDOW, np.int64)
    part = char_ids(text[start : start + TRAIN_WINDOW])
    ids[: len(part)] = part
    for k, a, b in spans:
        a, b = a - start, min(b - start, TRAIN_WINDOW)
        if a < TRAIN_WINDOW and b > 0:
            tags[max(a, 0) : b] = 2 * k + 2
            if a >= 0:
                tags[a] = 2 * k + 1
    return ids, tags


def examples(texts: list[str], windows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Training windows out of the texts: as they stand, around base spans, and with invented spans and near misses set in."""
    rng, out = random.Random(seed), []
    spans = [base_spans(t) for t in texts]
    own = [(t, s) for t, s in zip(texts, spans) if s]
    for i in range(windows):
        if own and i % 4 == 0:
            t, s = rng.choice(own)
            out.append(tagged(t, s, max(0, rng.choice(s)[1] - rng.randint(0, TRAIN_WINDOW - 8))))
        elif texts and i % 4 == 1:
            k = rng.randrange(len(texts))
            out.append(tagged(texts[k], spans[k], rng.randint(0, max(0, len(texts[k]) - TRAIN_WINDOW))))
        else:
            t = rng.choice(texts) if texts else ""
            at = rng.randint(0, max(0, len(t) - TRAIN_WINDOW))
            t, have = t[at : at + TRAIN_WINDOW], []
            where = t.find(" ", rng.randint(0, TRAIN_WINDOW))
            where = len(t) if where < 0 else where
            if i % 4 == 2:
                kind = rng.randrange(len(KINDS))
                new = invented(rng, kind)
                have = [(kind, where + 1, where + 1 + len(new))]
            else:
                new = near_miss(rng)
            before = base_spans(t)
            t = f"{t[:where]} {new}{rng.choice(['', '', ',', '.'])}{t[where:]}"
            if before:  # spans of the sample move; keep it simple and label them afresh
                have = have + [s for s in base_spans(t) if not have or s[2] <= have[0][1] or s[1] >= have[0][2]]
            out.append(tagged(t, have, rng.randint(0, max(0, min(where, len(t) - TRAIN_WINDOW)))))
    return np.array([x for x, _ in out]), np.array([y for _, y in out])


def fit(docs: DataFrame, text_col: str = "text") -> Tagger:
    """Train on the texts with the least content hashes: at most ``TRAIN_ROWS`` / 2 of those that the
    base rules may label, and as many of all texts.

    The hashes are chosen first, so that only the chosen texts leave their tasks."""
    text = F.col(text_col)
    rows = docs.select(text.alias("t"), F.xxhash64(text).alias("h")).where("t is not null")
    half = TRAIN_ROWS // 2

    def last(chosen: DataFrame) -> int | None:
        return chosen.select("h").distinct().orderBy("h").limit(half).agg(F.max("h")).first()[0]

    plain, likely = last(rows), last(rows.where(text_like("t")))
    chosen = F.lit(False)
    if plain is not None:
        chosen = F.col("h") <= plain
    if likely is not None:
        chosen = chosen | ((F.col("h") <= likely) & text_like("t"))
    texts = sorted(r["t"] for r in rows.where(chosen).groupBy("h").agg(F.min(_part("t")).alias("t")).collect())
    tagger = Tagger(len(KINDS))
    ids, tags = examples(texts, TRAIN_WINDOWS, seed=5)
    tagger.train(ids, tags, STEPS, batch=48)
    return tagger


def text_like(column: str) -> F.Column:
    return F.col(column).rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{4}[ -]?[0-9]{4}")


def _part(column: str) -> F.Column:
    """Of a long training row, 4,000 characters around the first likely place."""
    at = F.regexp_instr(column, F.lit(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]{4}[ -]?[0-9]{4}"))
    return F.substring(F.col(column), F.greatest(at - 2000, F.lit(1)), F.lit(4000))


# --------------------------------------------------------------- decoding
def plausible(kind: int, text: str) -> bool:
    """The checks of the base rules on what a span says, whatever its separators."""
    if kind == 0:
        plain = re.sub(r"\s*[\[(]?\s*\b(?:dot|DOT)\b\s*[\])]?\s*", ".", re.sub(r"\s*(?:[\[(]\s*(?:at|AT)\s*[\])]|\bat\b|\bAT\b|@)\s*", "@", text, count=1))
        found = emails(plain)
        return len(found) == 1 and found[0][1:] == (0, len(plain))
    if kind == 1:
        parts = re.split(r"\s*(?:\[\.\]|\.)\s*", text)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and octet(p) for p in parts)
    digits = _digits(text)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 .-]*[0-9]", text)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(0-9][0-9() .-]*[0-9]", text)) and 8 <= len(digits) <= 15 and any(c in " ().-+" for c in text)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first character) of every window; the last window of a long text ends with it."""
    many = np.where(lengths <= WINDOW, (lengths > 0).astype(np.int64), -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return text, np.minimum(k * STRIDE, np.maximum(lengths[text] - WINDOW, 0))


_AT = re.compile(r"(?:@|\b(?:at|AT)\b\s*+(?:[\])])?+)\s*+(?=[A-Za-z0-9-])")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"\.|\s*+[\[(]?+\s*+(?:dot|DOT)\b")
_NUMBERS = re.compile(r"[0-9+(][0-9\s().+\[\]-]*")


def places(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end), in no order, one of which every ``plausible`` span of the text shares a character with.

    A plausible name holds an @ or "at" that a label and a dot or "dot" follow: the first character of
    the @ or "at" is such a stretch.  A plausible number lies whole in a run of digits, blanks and marks
    that has four digits and three dots, or eight digits.  Each is found in one pass over the text."""
    out, end, dotted = [], 0, False
    for m in _AT.finditer(text):
        if m.end() >= end:
            end = _LABEL.match(text, m.end()).end()
            dotted = bool(_DOT.match(text, end)) or "dot" in text[m.end() : end] or "DOT" in text[m.end() : end]
        if dotted:
            out.append((m.start(), m.start() + 1))
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= 7:
            run = m.group()
            n = len(_digits(run))
            if n >= 8 or n >= 4 and run.count(".") >= 3:
                out.append(m.span())
    return out


def _near(first: np.ndarray, start: np.ndarray, text: int, a: int, b: int) -> slice:
    """The windows of a text that share a character with a stretch of it."""
    own = start[first[text] : first[text + 1]]
    return slice(first[text] + int(np.searchsorted(own, a - WINDOW, side="right")), first[text] + int(np.searchsorted(own, b)))


def tag_texts(tagger: Tagger, texts: list[str], screen: bool = False) -> list[list[Span]]:
    """Reconciled spans of the tagger in each text; with ``screen`` perhaps without some that are not ``plausible``.

    The screen decodes the windows that share a character with one of ``places``, then all windows that a
    span found there reaches into, until no more come.  So the spans of a window left out overlap none that were
    found: they neither grow nor hide one, and what they would make together shares no character with a place."""
    lengths = np.array([len(t) for t in texts], np.int64)
    text, start = windows(lengths)
    raw: list[list[Span]] = [[] for _ in texts]
    wanted = np.full(len(text), not screen)
    of_text = np.searchsorted(text, np.arange(len(texts) + 1))
    if screen:
        for i, t in enumerate(texts):
            for a, b in places(t):
                wanted[_near(of_text, start, i, a, b)] = True
        if not wanted.any():
            return raw
    ids = np.append(char_ids("".join(texts)), np.uint8(PAD))
    first = np.concatenate([[0], np.cumsum(lengths)])
    done = np.zeros(len(text), bool)
    while len(todo := np.flatnonzero(wanted & ~done)):
        for i, span in _decoded(tagger, ids, first, lengths, text[todo], start[todo]):
            raw[i].append(span)
            wanted[_near(of_text, start, i, *span[1:])] = True
        done[todo] = True
    return [reconcile(x) for x in raw]


def _decoded(tagger: Tagger, ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, text: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, Span]]:
    """(text, span) of all spans of the given windows that are theirs to decide."""
    for at in range(0, len(text), BATCH):
        rows, begin = text[at : at + BATCH], start[at : at + BATCH]
        place = begin[:, None] + np.arange(WINDOW)
        inside = place < lengths[rows][:, None]
        window = ids[np.where(inside, first[rows][:, None] + place, len(ids) - 1)]
        tags = tagger.decode(window)
        for r in np.flatnonzero(tags.any(axis=1)).tolist():
            own, n = tags[r], int(lengths[rows[r]])
            low = 0 if begin[r] == 0 else MARGIN  # near an edge with more text beyond, the neighbour decides
            high = WINDOW if begin[r] + WINDOW >= n else WINDOW - MARGIN
            starts = np.flatnonzero((own > 0) & ((own % 2 == 1) | (np.append(0, own[:-1]) == 0)))
            for s in starts.tolist():
                kind, e = (int(own[s]) - 1) // 2, s + 1
                while e < WINDOW and own[e] == 2 * kind + 2:
                    e += 1
                if s < high and e > low:
                    yield int(rows[r]), (kind, int(begin[r]) + s, min(int(begin[r]) + e, n))


def reconcile(spans: list[Span]) -> list[Span]:
    """Overlapping spans of one kind become one; of overlapping kinds the longest stays, then the earliest."""
    merged: list[Span] = []
    for k, a, b in sorted(set(spans)):
        if merged and merged[-1][0] == k and a < merged[-1][2]:
            merged[-1] = (k, merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((k, a, b))
    out: list[Span] = []
    for s in sorted(merged, key=lambda s: (s[1] - s[2], s[1], s[0])):
        if all(s[2] <= o[1] or s[1] >= o[2] for o in out):
            out.append(s)
    return sorted(out)


def trimmed(text: str, span: Span) -> Span:
    """Without blanks and closing marks that belong to the sentence."""
    k, a, b = span
    while a < b and (text[a].isspace() or text[a] in ",;:\"'"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?\"'"):
        b -= 1
    return k, a, b


def all_spans(tagger: Tagger, texts: list[str], screen: bool = True) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the tagger adds) of each text."""
    out = []
    for text, found in zip(texts, tag_texts(tagger, texts, screen)):
        base, added = base_spans(text), []
        for s in found:
            s = trimmed(text, s)
            if s[1] < s[2] and plausible(s[0], text[s[1] : s[2]]) and all(s[2] <= o[1] or s[1] >= o[2] for o in base):
                added.append(s)
        out.append((base, added))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per document row: (id, spans), spans an array of (kind, start, end,
    base), by kind as in ``KINDS`` and then start; code points, end exclusive.

    ``base`` tells the spans of the base rules from those that the tagger adds.
    Null and empty texts have no spans; ids may be null or repeat; an empty
    table gives no rows.  Other columns are not read.
    """
    tagger = tagger or fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("bytes"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "bytes"):
            found = all_spans(shared.value, [t.decode("utf-8", "replace") for t in b.column("bytes").to_pylist()])
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "base": plain} for k, s, e, plain in sorted(
                [(*x, True) for x in base] + [(*x, False) for x in added])] for base, added in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], ["id", "spans"])

    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that
    overlap are replaced together, under the kind of the first.  ``length_col``,
    if it is there, is set to the new number of code points.  Null texts stay
    null with their length; the other columns and their order are kept, whatever their
    names.  Rows that repeat are replaced alike; an empty table gives an empty one."""
    tagger = tagger or fit(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    schema: StructType = docs.schema
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col in docs.columns else None
    name = unused("__pii_bytes", docs.columns)
    keyed = docs.withColumn(name, as_bytes(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name):
            texts = [t.decode("utf-8", "replace") for t in b.column(b.num_columns - 1).to_pylist()]
            given = b.column(at).is_valid().to_pylist()
            new = [replaced(t, base + added) if ok else None for t, ok, (base, added) in zip(texts, given, all_spans(shared.value, texts))]
            columns = [b.column(i) for i in range(len(schema))]
            columns[at] = pa.array(new, columns[at].type)
            if n_at is not None:
                old = columns[n_at]
                columns[n_at] = pa.array([n if t is None else len(t) for t, n in zip(new, old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.mapInArrow(run, schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def base_sha256(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
