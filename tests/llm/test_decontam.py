import random
import re

import pytest

from periodlens.llm import decontam, queries
from periodlens.llm.common import read


def plain(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best


def brute(docs, items, min_score=0.5):
    out = {}
    for d, text in docs:
        w = plain(text)
        have = set(w)
        for i, t in items:
            own = plain(t)
            if own and 2 * sum(x in have for x in own) / (2 * len(own)) >= min_score:
                score = smith_waterman(own, w) / (2 * len(own))
                if score >= min_score:
                    out[d, i] = score
    return out


def test_table_matches_brute_force(spark, sf001):
    docs = [tuple(r) for r in read(spark, sf001, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, sf001, "benchmark").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.score for r in queries.op10_decontamination(spark, sf001).collect()}
    want = brute(docs, items)
    assert want and got == pytest.approx(want)


@pytest.fixture(scope="module")
def edited():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(None, "never used at all"), (50, ""), (51, None), (52, "two words"), (52, "two words")]
    docs = [(i, " ".join(word() for _ in range(200))) for i in range(20)]
    for i in range(12):  # edited copies: words replaced, dropped and added
        w = items[i][1].split()
        for _ in range(i % 6):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], ["edit"], [w[k], "more"]))
        docs.append((100 + i, f"{docs[i][1]}. {' '.join(w).upper()}! {docs[i + 1][1]}"))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "these two, words!"), (203, "x " * 60_000 + items[3][1]), (203, items[2][1])]
    return docs, items


def test_edited_copies(spark, edited):
    docs, items = edited
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contamination(df, bench).collect()}
    want = brute(docs[:-2], [x for x in items if x[0] is not None]) | {(203, 3): 1.0, (203, 2): 1.0}
    assert got == pytest.approx(want)
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 200, 201]


def test_blocks_of_items(spark, edited, monkeypatch):
    docs, items = edited
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.contamination(df, bench).collect()), key=str)
    left = sorted(r.doc_id for r in decontam.clean(df, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, decontam.contamination(df, bench).collect()), key=str) == want
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == left


def test_empty_tables(spark, edited):
    docs, items = edited
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contamination(df.limit(0), bench).count() == 0
    assert decontam.contamination(df, bench.limit(0)).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("exact_beside", [False, True])
def test_copies_with_many_words_replaced_or_inserted(spark, exact_beside):
    """Edits that destroy more than half of an item's 3-grams."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    items = [(i, " ".join(word() for _ in range(36))) for i in range(12)]
    edits = [
        lambda w: [word() if k % 4 == 3 else x for k, x in enumerate(w)],
        lambda w: [word() if k % 5 == 4 else x for k, x in enumerate(w)],
        lambda w: [y for k, x in enumerate(w) for y in ((x, word()) if k % 3 == 2 else (x,))],
        lambda w: [word() if k in replaced else x for k, x in enumerate(w)],
    ]
    docs = []
    for i, t in items:
        replaced = set(rng.sample(range(36), 9))
        around = [" ".join(word() for _ in range(80)) for _ in range(2)]
        docs.append((i, f"{around[0]} {' '.join(edits[i % 4](t.split()))} {around[1]}"))
    if exact_beside:
        docs += [(100 + i, f"{t}. {docs[0][1]}") for i, t in items for _ in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(i, i) for i in range(12)} <= set(want)
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contamination(df, bench).collect()} == pytest.approx(want)
    assert decontam.clean(df, bench).count() == 0


def test_few_seeds_held_at_a_time(spark, edited, monkeypatch):
    docs, items = edited
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.contamination(df, bench).collect()), key=str)
    h, row = [], []
    for k, (_, t) in enumerate(docs):
        own = decontam.words(*decontam._one((t or "").encode()), decontam.PLAIN_WORDS)[3]
        h.append(own)
        row += [k] * len(own)
    seeds = decontam.Block(*next(decontam._items(bench, "item_id", "text"))).seeds()
    all_at_once = sorted(decontam.scores(seeds, decontam.np.concatenate(h), decontam.np.array(row), 0.5))
    monkeypatch.setattr(decontam, "FOUND_ROWS", 5)
    assert sorted(decontam.scores(seeds, decontam.np.concatenate(h), decontam.np.array(row), 0.5)) == all_at_once and len(all_at_once) >= len(want)


def test_everyday_ngrams_are_no_seeds():
    """An item of common n-grams with a few rare ones makes candidates only where those stand; one copied often keeps all."""
    rng = random.Random(6)
    item = [f"w{k}" for k in range(36)]
    common = [" ".join(item[k : k + 3]) for k in range(0, 30)]
    docs = [" ".join(rng.choice(common) if rng.random() < 0.3 else f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    hot = [f"h{k}" for k in range(36)]
    docs += [" ".join(item), *[" ".join(hot)] * 300]
    own = [decontam.words(*decontam._one(t.encode()), decontam.PLAIN_WORDS)[3] for t in (" ".join(item), " ".join(hot), "never seen in any text")]
    block = decontam.Block(decontam.np.concatenate([[k] * (len(h) + 1) for k, h in enumerate(own)]), decontam.np.concatenate([decontam.np.append(h, decontam.np.uint64(0)) for h in own]))
    h = [decontam.words(*decontam._one(t.encode()), decontam.PLAIN_WORDS)[3] for t in docs]
    row = decontam.np.repeat(range(len(docs)), [len(x) for x in h])
    h = decontam.np.concatenate(h)
    known, times = decontam.np.unique(decontam._grams(h, row, 3)[0], return_counts=True)
    few = block.rare_seeds(known, times, rare=10)
    found = lambda seeds: {(int(x[0]), int(x[1])) for part in decontam.candidates(seeds, h, row) for x in part}
    every = found(block.seeds())
    assert sum(i == 0 for _, i in every) > 350 and {i for _, i in found(few)} == {0, 1}
    assert sum(i == 0 for _, i in found(few)) < 40 and (400, 0) in found(few)
    assert (few.item == 1).sum() == 34 and not (few.item == 2).any()


def test_copies_of_a_frequent_item_stay_found(spark):
    """Exact copies far above ``rare``, edited ones beside them."""
    rng = random.Random(7)
    text = " ".join(f"q{k}" for k in range(36))
    docs = [(k, text) for k in range(60)] + [(100 + k, " ".join(f"e{rng.randrange(99)}" if rng.random() < 0.2 else w for w in text.split())) for k in range(40)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")
    want = brute(docs, [(1, text)])
    assert len(want) > 90 and {(r.doc_id, r.item_id): r.score for r in decontam.contamination(df, bench, rare=1).collect()} == pytest.approx(want)
    assert decontam.clean(df, bench, rare=1).count() == len(docs) - len(want)
