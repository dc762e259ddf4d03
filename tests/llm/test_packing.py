import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from periodlens.llm import packing, queries
from periodlens.llm.common import read


def check(rows, docs, length=1024):
    """Round trip: pieces make up their documents, sequences are gapless and not too long."""
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for doc, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        n, first = len(ids), len(ids) % length or length
        cuts = [0, n] if n <= length else [0, *range(first, n + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= length
    return len(by), -(-sum(r.length for r in rows) // length)


def test_table(spark, sf001):
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    used, least = check(queries.op7_packing(spark, sf001).collect(), docs)
    assert used <= least + 1


def test_edge_rows(spark):
    docs = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (4, "x<|endoftext|>y"), (5, "word " * 5000), (6, "é\U0001f600 " * 900), (7, "word " * 1023), (8, "word " * 1024)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, length int, part int").repartition(3)
    packed = packing.pack(df, queries.tokenizer_path())
    check(packed.collect(), docs)
    seqs = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 99): rng.randint(1, 60) for _ in range(20)}
    bins, held = Counter(), {}
    for size, rank, n, first, offset in packing.plan(counts, 100):
        for i in range(n):
            assert (size, rank + i) not in held
            held[size, rank + i] = first + i
            assert bins[first + i] == offset
            bins[first + i] += size
    assert set(held) == {(s, r) for s, n in counts.items() for r in range(n)} and max(bins.values()) <= 100
    plain = []  # best fit decreasing, one piece at a time
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [i for i, used in enumerate(plain) if used + size <= 100]
            if fits:
                plain[max(fits, key=lambda i: plain[i])] += size
            else:
                plain.append(size)
    assert len(bins) <= len(plain)
