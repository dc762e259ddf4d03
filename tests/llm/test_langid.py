import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodlens.llm import langid, queries

EN = "the house of the river and this is that which they were with the people of their own country".split()
FR = "les maisons de la riviere avec une autre chose que vous avez dans notre pays pour cette femme".split()


def text(rng, words, n=40):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    out = []
    for i in range(300):
        lang = ("en", "fr")[i % 2]
        declared = lang if i % 10 else ("fr", "en")[i % 2]  # a tenth declares the wrong one
        url = f"https://{'h' if i % 2 else 'k'}{i % 6}.{'site' if i % 2 else 'lieu'}.{'org' if i % 2 else 'fr'}/p/{i}"
        out.append((i, text(rng, EN if lang == "en" else FR), declared, url, lang))
    out += [(900, None, "en", None, ""), (901, "", None, "no address", ""), (902, "12 345 !! ###", "fr", None, ""), (903, "zq" * 400, None, None, ""),
            (904, text(rng, EN, 50_000), "xx-unknown", "http://[broken", "en"), (905, text(rng, FR), "FR-ca", None, "fr"), (905, text(rng, EN), None, None, "en"),
            (906, text(rng, FR, 3000), "en", "https://h1.site.org/", "fr")]
    return spark.createDataFrame([(*r, "clash", 1) for r in out], "id long, body string, d string, u string, want string, language string, n_grams int").repartition(4)


def test_fusion(rows):
    found = langid.identify(rows, "body", "d", "u")
    assert found.columns == ["id", "body", "d", "u", "want", *langid.RESULT]
    for r in found.collect():
        if r.want:
            assert (r.language, r.accepted) == (r.want, True), r
        else:
            assert (r.language, r.accepted, r.posterior) == ("und", False, 0.0), r


def test_declaration_and_host_move_the_posterior(spark, rows):
    short = [(1000, "pour the", "en", "https://k0.lieu.fr/a", ""), (1001, "pour the", "fr", "https://h1.site.org/a", ""), (1002, "pour the", None, None, "")]
    extra = spark.createDataFrame([(*r, "", 0) for r in short], rows.schema)
    found = langid.identify(rows.unionByName(extra), "body", "d", "u").where("id >= 1000").collect()
    english = {r.id: r.posterior if r.language == "en" else 1 - r.posterior for r in found}
    assert english[1000] > english[1002] > english[1001]


def test_posterior_matches_plain_arithmetic(spark, rows):
    """The fused posterior recomputed row by row, host by host, from the same counts."""
    found = {(r.id, r.body): r for r in langid.identify(rows, "body", "d", "u").collect()}
    data = rows.select("id", "body", langid.declared_code("d").alias("c"), F.coalesce(langid.host_of("u"), F.lit("")).alias("h")).collect()
    langs = ["en", "fr"]
    counts = np.zeros((langid.BUCKETS, 2))
    grams = []
    for r in data:
        b = (r.body or "").encode()
        _, bucket = langid.buckets(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        grams.append(bucket)
        if r.c in langs:
            np.add.at(counts[:, langs.index(r.c)], bucket, 1)
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * langid.BUCKETS) * langid.BUCKETS)
    ev = [table[g].sum(0) * min(len(g), 40) / max(len(g), 1) for g in grams]
    k = [int(np.argmax(e)) if len(g) else None for e, g in zip(ev, grams)]

    def tally(key):
        t = {}
        for r, x in zip(data, k):
            if x is not None:
                t.setdefault(key(r.h), np.zeros(2))[x] += 1
        return t

    dom = lambda h: (".".join(h.split(".")[-2:]), h.split(".")[-1] if "." in h else "")
    host, domain, suffix, every = tally(lambda h: h), tally(dom), tally(lambda h: dom(h)[1]), tally(lambda h: 0)[0]
    seen = np.full((3, 2), 0.5)
    for r, x in zip(data, k):
        if x is not None:
            seen[langs.index(r.c) if r.c in langs else 2][x] += 1
    decl = np.log(seen / seen.sum(0))
    decl[2] = 0
    smooth = lambda n, p: (n + 10 * p) / (n.sum() + 10)
    for r, e, g in zip(data, ev, grams):
        if len(g) and e.max() > 0:
            p = smooth(every, np.full(2, 0.5))
            p = smooth(suffix[dom(r.h)[1]], p)
            p = smooth(host[r.h], smooth(domain[dom(r.h)], p))
            z = e + decl[langs.index(r.c) if r.c in langs else 2] + np.log(p)
            post = np.exp(z - z.max())
            got = found[r.id, r.body]
            assert got.language == langs[int(np.argmax(z))]
            assert got.posterior == pytest.approx(post.max() / post.sum(), rel=1e-4)


def test_empty_table_and_no_declarations(spark):
    none = spark.createDataFrame([], "t string, d string")
    assert langid.identify(none, "t", "d").count() == 0
    one = spark.createDataFrame([("some words", None)], "t string, d string")
    assert [r.accepted for r in langid.identify(one, "t", "d").collect()] == [False]


def test_table_accuracy(spark, sf001):
    got = queries.op6_language(spark, sf001).collect()
    assert len(got) == spark.read.parquet(f"{sf001}/documents.parquet").count() + spark.read.parquet(f"{sf001}/pages.parquet").count()
    right = [r.language == r.declared for r in got]
    assert sum(right) >= 0.98 * len(right)
    assert sum(r.kept for r in got) >= 0.98 * len(right)


def test_more_languages_than_two_hundred(spark):
    """Every declared language with enough rows has a model, however many there are."""
    import random
    import string
    rng = random.Random(3)
    codes = [a + b for a in string.ascii_lowercase[:13] for b in string.ascii_lowercase][:300]
    words = {c: ["".join(rng.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(30)] for c in codes}
    rows = [(i, " ".join(rng.choice(words[c]) for _ in range(40)), c) for i, c in enumerate(codes * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, "text", "lang").select("doc_id", "language", "accepted").collect()
    assert len(got) == len(rows) and all(r.accepted and r.language == rows[r.doc_id][2] for r in got)
    blank = langid.identify(docs.selectExpr("doc_id", "text", "IF(doc_id >= 1800, NULL, lang) AS lang"), "text", "lang").where("doc_id >= 1800").collect()
    assert len(blank) == 300 and all(r.language == rows[r.doc_id][2] for r in blank)
