import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from periodlens.llm import pii, queries
from periodlens.llm.common import read
from periodlens.llm.lstm import PAD, Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    d = [int(x) for x in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain(text):
    """The base rules as the contract words them."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.0125 +-()_é\n4", max_size=60))
def test_base_rules(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4465758382889437", "1.2.3.4", "1.2.3.400", "a.b@c.d", "@x.y", "a@b@c.de", "+1 (499) 555-6503", "0049", ".", " ", "-", "7"]), max_size=12))
def test_base_rules_on_joined_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)


def test_base_rules_are_linear():
    text = "a" * 300_000 + "@" + "1" * 300_000 + "@" + "1." * 100_000 + "+" * 100_000 + "+1" + " " * 200_000
    assert pii.base_spans(text) is not None


@pytest.fixture(scope="module")
def tagger(spark, sf001):
    return pii.fit(read(spark, sf001, "documents"))


def test_held_out_accuracy(spark, sf001, tagger):
    texts = [r.text for r in read(spark, sf001, "documents").where("text is not null").collect()]
    rng, right, made, found_n = random.Random(99), 0, 0, 0
    for _ in range(400):
        t = rng.choice(texts)[:300]
        t = t[: t.rfind(" ") + 1]
        if pii.base_spans(t):
            continue
        kind = rng.randrange(4)
        new = pii.invented(rng, kind)
        text = f"{t}{new} and {t}"
        got = pii.tag_texts(tagger, [text])[0]
        made, found_n = made + 1, found_n + len(got)
        right += any(k == kind and abs(a - len(t)) <= 1 and abs(b - len(t) - len(new)) <= 1 for k, a, b in map(lambda s: pii.trimmed(text, s), got))
    assert right >= 0.85 * made and right >= 0.8 * found_n


def test_clean_text_is_left_alone(spark, sf001, tagger):
    texts = [r.text or "" for r in read(spark, sf001, "documents").collect()]
    added = [(t[s[1] : s[2]], s) for t, (_, new) in zip(texts, pii.all_spans(tagger, texts)) for s in new]
    assert len(added) <= 0.02 * len(texts), added


def test_windows_cover_every_character():
    for n in [0, 1, pii.WINDOW, pii.WINDOW + 1, pii.WINDOW + pii.STRIDE, 5 * pii.WINDOW + 3]:
        text, start = pii.windows(np.array([n, 7]))
        seen = np.zeros(n, bool)
        for k, s in zip(text, start):
            if k == 0:
                low = 0 if s == 0 else pii.MARGIN
                high = pii.WINDOW if s + pii.WINDOW >= n else pii.WINDOW - pii.MARGIN
                seen[s + low : s + high] = True
        assert seen.all()


def test_skipped_windows_have_no_better_path(tagger):
    rng = np.random.default_rng(0)
    ids = rng.integers(32, 128, (300, 40)).astype(np.uint8)
    best = tagger._viterbi(tagger.scores(ids), tagger.transitions())
    assert (tagger.decode(ids) == best).all()


PARTS = ["joe", "a.b", " at ", " [at] ", "(at)", "@", " @ ", "at", "AT", "-at-", " dot ", "(dot)", ".", " [ dot ] ", "-dot", "host", "com", "+1 (499) 555-6503", "10", "255", " . ",
         "[.]", "4111 1111 1111 1111", "4111  1111 - 1111.1111", "5556503", "0049 30 1234 5678", " ", "-", "(", "]", "\n", "\u2003", "é", "\U0001f600", " looked at the sun. ", "x" * 250]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.integers(0, 60), st.integers(1, 60))
def test_places_meet_every_plausible_span(parts, a, n):
    text = "".join(parts)
    s = pii.trimmed(text, (0, a, min(a + n, len(text))))
    if s[1] < s[2] and any(pii.plausible(k, text[s[1] : s[2]]) for k in range(4)):
        assert any(x < s[2] and y > s[1] for x, y in pii.places(text))


def test_places_of_invented_spans():
    rng = random.Random(3)
    for _ in range(4000):
        kind = rng.randrange(4)
        new = pii.invented(rng, kind)
        if pii.plausible(kind, new):
            text, at = f"at most é {new}, 12 of", 10
            assert any(x < at + len(new) and y > at for x, y in pii.places(text)), new


def test_places_are_linear():
    pii.places("at-" * 100_000 + "at" + " " * 300_000 + "]" + " " * 300_000 + "@x" + " " * 300_000 + "1 " * 300_000 + "@" * 300_000)


def test_screen_changes_nothing(spark, sf001, tagger):
    rng = random.Random(17)
    texts = [r.text or "" for r in read(spark, sf001, "documents").collect()]
    for i in range(0, len(texts), 3):  # some texts with spans, plain and split by the edge of a window, set in
        for _ in range(rng.randint(1, 6)):
            at = rng.choice([rng.randint(0, len(texts[i])), max(0, pii.STRIDE * rng.randint(0, 4) + rng.randint(-30, 40))])
            texts[i] = f"{texts[i][:at]} {pii.invented(rng, rng.randrange(4))} {texts[i][at:]}"
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(300)] + [" ".join(pii.invented(rng, 3) for _ in range(200))]
    want = pii.all_spans(tagger, texts, screen=False)
    assert pii.all_spans(tagger, texts) == want and sum(len(a) for _, a in want) > 50


def test_gradient():
    t, rng = Tagger(2, hidden=3), np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    ids, tags = rng.integers(0, PAD, (3, 7)).astype(np.uint8), np.array([[0, 1, 2, 0, 3, 4, 0]] * 3)
    _, g = t.gradient(ids, tags)
    for k, at in [("u", (0, 1, 2)), ("u", (1, 2, 7)), ("o", (1, 0, 3)), ("b", (2,)), ("a", (0, 1)), ("x", (1, int(ids[0, 2]), 5))]:
        old, e = t.p[k][at], 1e-2
        t.p[k][at] = old + e
        up = t.gradient(ids, tags)[0]
        t.p[k][at] = old - e
        down = t.gradient(ids, tags)[0]
        t.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_query_against_plain_rules(spark, sf001):
    docs = sorted((r.doc_id, r.text or "") for r in read(spark, sf001, "documents").collect())
    got = sorted(queries.op3_pii(spark, sf001).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(docs)
    for r, (i, text) in zip(got, docs):
        base = plain(text)
        own = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert (r.doc_id, r.base_sha256) == (i, hashlib.sha256(own.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        spans = [s for s in r.spans.split(",") if s]
        assert set(own.split(",")) - {""} <= set(spans)
        key = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)


def test_edge_rows(spark, tagger):
    docs = [(1, None), (1, ""), (None, "a.b@c.de"), (None, "a.b@c.de"), (3, "x" * 300_000 + " 10.0.0.1"), (4, "é\U0001f600 mail: a@b.co\U0001f600 " * 3)]
    df = spark.createDataFrame([("clash", i, t, 5) for i, t in docs], "spans string, doc_id long, text string, n_chars int")
    got = sorted(((r.doc_id, [(s["kind"], s.start, s.end) for s in r.spans if s.base]) for r in pii.find(df, tagger=tagger).collect()), key=str)
    assert got == sorted(((i, [(pii.KINDS[k], a, b) for k, a, b in plain(t or "")]) for i, t in docs), key=str)
    out = pii.redact(df, tagger=tagger)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    by = sorted(out.collect(), key=str)
    assert [r.text for r in by if r.doc_id is None] == ["<EMAIL>"] * 2
    assert {(r.text, r.n_chars) for r in by if r.doc_id == 1} == {(None, 5), ("", 0)}
    assert all(len(r.text) == r.n_chars for r in by if r.text is not None)
    assert "10.0.0.1" not in next(r.text for r in by if r.doc_id == 3)
    assert pii.find(df.limit(0), tagger=tagger).count() == 0


def test_fit_without_rows(spark):
    assert pii.fit(spark.createDataFrame([], "text string")).kinds == 4


def test_reconcile():
    assert pii.reconcile([(0, 5, 9), (0, 7, 12), (1, 11, 13), (3, 20, 22)]) == [(0, 5, 12), (3, 20, 22)]
    assert pii.replaced("abcdef", [(0, 1, 3), (1, 2, 5)]) == "a<EMAIL>f"
