import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from periodlens.llm import fertility, queries
from periodlens.llm.common import read


def plain(text):
    """The base counts as the contract words them."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(rows, docs):
    t = Tokenizer.from_file(queries.tokenizer_path())
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows), key=key)
    assert got == sorted(((i, plain(x)) for i, x in docs), key=key)
    lengths = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == lengths
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.reasons)


def test_table(spark, sf001):
    docs = [(r.doc_id, r.text) for r in read(spark, sf001, "documents").collect()]
    rows = queries.op4_quality(spark, sf001).collect()
    check(rows, docs)
    assert sum(r.kept for r in rows) >= 0.9 * sum(not r.base_failed for r in rows)


def test_bands_reject_odd_texts_only(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice(["the", "ing", "er", "on", "at", "re"]) for _ in range(2)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 400))), "en") for i in range(120)]
    docs += [(500, " ".join(f"{rng.getrandbits(60):x}" for _ in range(80)), "en"), (501, " ".join("中\U00012345\U0001f9ff"[rng.randrange(3)] + chr(0x12000 + rng.randrange(900)) for _ in range(80)), "en")]
    docs += [(600, None, "en"), (601, "", None), (None, " ".join(words), None), (None, " ".join(words), None), (602, " ".join(words) + " x" * 1 + "y" * 200_000, "de"), (603, "\x00a b\x0bc|\n \n", "en")]
    df = spark.createDataFrame([(i, t, g, True) for i, t, g in docs], "doc_id long, text string, lang string, kept boolean").repartition(4)
    rows = fertility.judge(df, queries.tokenizer_path()).collect()
    check(rows, [(i, t) for i, t, _ in docs])
    by = {r.doc_id: r for r in rows}
    assert "chars_per_token" in by[500].reasons and "fallback_share" in by[501].reasons
    assert all(by[i].kept for i in range(120))
    assert fertility.judge(df.limit(0), queries.tokenizer_path()).count() == 0


def test_entropy():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40, 1000).astype(np.uint32)
    want = np.mean([-sum(n / 256 * math.log2(n / 256) for n in Counter(ids[k : k + 256].tolist()).values()) / 8 for k in (0, 256, 512)])
    assert fertility.entropy(ids) == pytest.approx(want)
    assert fertility.entropy(np.arange(50, dtype=np.uint32)) == pytest.approx(1.0)
    assert fertility.entropy(np.zeros(300, np.uint32)) == pytest.approx(0.0)


def test_every_token_counts_in_the_entropy(spark):
    """Texts that end in a repetitive tail behind the last full piece."""
    rng = np.random.default_rng(1)
    for n in (260, 300, 511, 520, 1000):
        ids = rng.integers(0, 5000, n).astype(np.uint32)
        rest, flat = n % 256, ids.copy()
        flat[n - rest :] = 7
        share = lambda x: 1 - sum(k * math.log2(k) for k in Counter(x.tolist()).values()) / 2048
        full = sum(share(flat[k : k + 256]) for k in range(0, n - rest, 256))
        assert fertility.text_entropy(flat) == pytest.approx((256 * full + rest * share(flat[-256:])) / n)
        assert fertility.text_entropy(flat) < fertility.text_entropy(ids)
    for n in (0, 1, 2, 100, 256, 512):
        assert fertility.text_entropy(ids[:n]) == fertility.entropy(ids[:n])

    t = Tokenizer.from_file(queries.tokenizer_path())
    head = " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 400).tolist())
    head = t.decode(t.encode(head, add_special_tokens=False).ids[:256])
    texts = {1: head + " the cat sat on the mat" * 34, 2: head}
    rows = fertility.judge(spark.createDataFrame([(i, x, "en") for i, x in texts.items()], "doc_id long, text string, lang string"), queries.tokenizer_path()).collect()
    got = {r.doc_id: r.entropy for r in rows}
    assert 256 < len(t.encode(texts[1], add_special_tokens=False).ids) < 512 and got[1] < got[2] - 0.1
