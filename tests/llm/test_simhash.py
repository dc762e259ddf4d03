import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from periodlens.llm import queries, simhash
from periodlens.llm.common import Stages, read
from periodlens.llm.components import components


def _components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def brute(docs, shingle=3, bits=3):
    fps = []
    for _, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
        parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
        fps.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    own = _components(len(fps), links)
    least = {}
    for i, c in enumerate(own):
        if docs[i][0] is not None:
            least[c] = min(least.get(c, docs[i][0]), docs[i][0])
    return sorted(((docs[i][0], f"{fps[i]:016x}", least.get(own[i])) for i in range(len(fps))), key=str)


def test_spark_hash_agrees(spark):
    t = "Ünï code the words"
    assert spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(t.encode(), seed=42)


def test_matches_brute_force_on_table(spark, sf001):
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op8_simhash(spark, sf001).collect()), key=str)
    assert got == brute(docs)


def test_edge_rows(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(400)]
    docs = [(5, None), (4, ""), (9, " \t\n"), (None, "one two three four"), (7, "One two THREE four"), (7, "one two three four"),
            (8, "solo"), (2, "solo\x0bpair"), (None, "nothing like it at all"), (1, " x y"), (30, "z" * 200_000)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(400)] = "edit"
        docs.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(t, i, "clash", 1) for i, t in docs], "text string, doc_id long, fp string, label int")
    got = sorted((tuple(r) for r in simhash.simhash_components(df).drop("content").collect()), key=str)
    assert got == brute(docs)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    want = {c for _, _, c in brute(docs) if c is not None}
    assert {i for i in ids if i is not None} == want
    assert sum(i is None for i in ids) == 1 and len(ids) == len(want) + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).count() == 0
    assert simhash.one_per_group(df).count() == 0


def test_large_groups_are_split_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 8)
    rng = random.Random(5)
    values = {0}
    while len(values) < 600:  # a dense cloud: most values are within three bits of another one
        values.add(rng.choice(sorted(values)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    own = sorted(values)
    want = _components(len(own), [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 3])
    signed = np.array(own, np.uint64).view(np.int64).tolist()
    stages = Stages(spark, "t")
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    label = {r.node: r.label for r in components(simhash.close_links(df, 3, stages), stages).collect()}
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, set()).add(label.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("bits", [1, 2, 3, 5])
def test_masks_cover_every_pair(bits):
    rng = random.Random(bits)
    masks = simhash.block_masks((1 << 64) - 1, bits)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), bits))
        assert any(a & m == b & m for m in masks)


def test_components_of_a_long_chain(spark):
    stages = Stages(spark, "chain")
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links, stages).collect()
    assert len(got) == 201 and {r.label for r in got} == {0}
