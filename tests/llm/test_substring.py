import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.llm import queries, substring, suffix
from periodlens.llm.common import read


def brute(docs):
    """The contract word by word: 50-byte strings and the least id of each."""
    key = lambda i: (i is None, i or 0)
    data = [(i, (t or "").encode()) for i, t in docs]
    least = {}
    for i, b in data:
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            least[s] = min(least.get(s, (True, 0)), key(i)) if s in least else key(i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def test_table_matches_brute_force(spark, sf001):
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op5_substrings(spark, sf001).collect()), key=str)
    want = brute(docs)
    assert got == [w[:5] for w in want] and any(w[2] for w in want)


def odd_docs():
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    common = [piece(n) for n in (30, 49, 50, 51, 80, 300)]
    docs = [(i, "".join(rng.choice(common + [piece(9), piece(60)]) for _ in range(rng.randint(0, 9)))) for i in rng.sample(range(1000), 60)]
    docs += [(7, "x" * 400), (3, "x" * 120 + "y"), (9, "ab" * 200), (8, "ba" * 100), (11, None), (12, ""), (13, "short"), (14, "short"), (15, "\x00" * 70), (16, "\x00" * 60 + "\x01"),
             (None, common[5] + "tail"), (None, common[5] + "tail"), (20, common[5]), (20, common[5] + common[4]), (21, common[5]), (21, common[5]),
             (30, piece(150_000) + common[4]), (31, "z" * 100_000)]
    return docs


def test_parts_are_dealt_one_to_a_bucket(spark):
    for n in (1, 8, 102, 3750):
        rows = substring._numbered(spark, n).select("slot", F.pmod(F.hash("part"), F.lit(n)).alias("bucket")).collect()
        assert sorted(r.slot for r in rows) == list(range(n)) and all(r.slot == r.bucket for r in rows)


@pytest.mark.parametrize("many, buckets", [(substring.MANY, substring.MOST_BUCKETS), (2, 5)])
def test_odd_texts(spark, monkeypatch, many, buckets):
    monkeypatch.setattr(substring, "MANY", many)
    monkeypatch.setattr(substring, "MOST_BUCKETS", buckets)
    monkeypatch.setattr(substring, "KEY_BYTES", 30_000)
    monkeypatch.setattr(substring, "PART_BYTES", 3000)
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2000)
    docs = odd_docs()
    df = spark.createDataFrame([("c", i, t, 1) for i, t in docs], "part string, doc_id long, text string, key int").repartition(4)
    got = sorted((tuple(r)[:5] + (bytes(r.kept),) for r in substring.deduplicate(df).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_against_sorting():
    rng = random.Random(1)
    for _ in range(150):
        depth = rng.choice([1, 3, 7, 8, 14, 50])
        letters = rng.choice([b"ab", b"abc", bytes([0, 1, 255]), b"a"])
        own = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))]
        texts = [bytes(rng.choice(letters) for _ in range(o + depth - 1)) for o in own]
        ids = np.array([rng.randint(0, 5) for _ in texts])
        got = suffix.least_of_equal(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.array(own), ids, depth)
        least = {}
        for t, o, i in zip(texts, own, ids):
            for k in range(o):
                least[t[k : k + depth]] = min(least.get(t[k : k + depth], 99), i)
        assert got.tolist() == [least[t[k : k + depth]] for t, o in zip(texts, own) for k in range(o)]
        symbols = np.array([x for t in texts for x in (*(b + 1 for b in t), 0)], np.int16)
        wanted = symbols > 0
        order = suffix.suffix_order(symbols, wanted, depth).tolist()
        heads = []
        for p in order:
            end = p + int(np.flatnonzero(symbols[p:] == 0)[0])
            heads.append(tuple(symbols[p:end].tolist())[:depth])
        assert len(order) == wanted.sum() and heads == sorted(heads)
        lcp = suffix.common_prefixes(symbols, np.array(order), depth)
        for a, b, n in zip(heads, heads[1:], lcp[1:]):
            if len(a) == len(b) == depth:
                same = next((k for k in range(depth) if a[k] != b[k]), depth)
                assert n == same
