import html
import itertools
import random
import re
import time

import pytest

from periodlens.llm import htmlcut, queries
from periodlens.llm.common import read


@pytest.fixture(scope="module")
def weights(spark, sf001):
    return htmlcut.fit(read(spark, sf001, "pages"))


def by_hand(page):
    """The article of the test pages, by their own layout."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", body))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_table_matches_the_articles(spark, sf001):
    pages = {r.page_id: r for r in read(spark, sf001, "pages").collect()}
    rows = queries.op1_main_text(spark, sf001).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, by_hand(pages[r.page_id].html), len(r.text))


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(250):
        n = rng.randint(1, 9)
        gain = [rng.choice([-3, -1.5, -0.5, 0, 0.25, 1, 2.5]) for _ in range(n)]
        smooth = {(i, j): rng.choice([0.25, 0.5, 1.0, 2.0]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(labels):
            own = sum(abs(g) for g, x in zip(gain, labels) if g and (g > 0) != x)
            return own + sum(w for (i, j), w in smooth.items() if labels[i] != labels[j])

        assert cost(htmlcut.minimum_cut(gain, smooth)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


LONG = "This sentence tells the story at some length, with commas, and it ends properly. Another one follows it here, also long enough."


def test_rich_page(weights):
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body class="page with-sidebar"><header><h1>Site</h1><a href=/>Home</a></header>
    <div id="cookie-notice"><p>{LONG}</p></div><nav><ul><li><a href="#">A</a><li><a href="#">B</a></ul></nav>
    <div class="wrapper"><main><article><h1>Title &amp; more</h1><div class='meta share-buttons'>Share this</div><p>{LONG} &lt;x&gt; 5&nbsp;&euro;</p><!-- <p>no</p> -->
    <script>var a = "<p>no</p>";</script><p title="a > b">One <b>two</b> <i>three</i><br>four<p>{LONG}</p><ul><li>First point</li><li>Second point</li></ul>
    <div class="ad">Buy now. {LONG}</div><blockquote>Said so.</blockquote><pre>x  =
 1</pre><form><label>Mail</label><input><button>Go</button></form><section id="comments"><p>{LONG}</p></section></article></main>
    <aside><p>{LONG}</p></aside></div><footer><p>&copy; 2020 {LONG}</p></footer></body></html>"""
    want = ["Title & more", f"{LONG} <x> 5 €", "One two three four", LONG, "First point", "Second point", "Said so.", "x = 1"]
    assert htmlcut.main_text(page, weights)[0].split("\n") == want


def test_page_without_article(weights):
    page = f'<body><div><a href=1>One</a> <a href=2>Two</a></div><div><p>{LONG}<p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div><a href=3>More</a></div></body>'
    assert htmlcut.main_text(page, weights)[0].split("\n") == [LONG, LONG, "Short one.", LONG]


def test_broken_markup_is_linear(weights):
    t = time.time()
    for page in ["<" * 200_000, "<a " * 100_000, '<p class="x' * 50_000, "<!--" * 50_000, "<p><b>" * 20_000 + "x", "&" * 200_000, "<article>" + "<p>word " * 20_000]:
        htmlcut.main_text(page, weights)
    assert time.time() - t < 30


def test_edge_rows(spark, weights):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>A  b</p></article>"), (None, None, "<article><p>A  b</p></article>"), (4, "u", "plain words only"),
            (5, "u", "<nav>x</nav>"), (6, "u", "<article><p>" + "word " * 60_000 + ".</p></article>")]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "page_id long, url string, html string, text string, n_blocks int").repartition(3)
    got = sorted(((r.page_id, r.text) for r in htmlcut.extract(df, weights=weights).collect()), key=str)
    assert (None, "A b") in got and got.count((None, "A b")) == 2 and got.count((1, "")) == 2 and (5, "") in got
    assert len(next(t for i, t in got if i == 6)) == 60_000 * 5 + 1
    assert htmlcut.extract(df.limit(0)).count() == 0


ARTICLE = f"<h1>Title of it</h1><p>{LONG}</p><p>{LONG} More.</p>"
AROUND = f'<nav><a href=1>One</a> <a href=2>Two</a></nav>%s<div class="ad"><p>Buy now. {LONG}</p></div><footer><p>&copy; 2020 all rights</p></footer>'
WANT = ["Title of it", LONG, f"{LONG} More."]


@pytest.mark.parametrize("wrapper", ["form action=x method=post", 'div class="site-content has-sidebar"', 'div class="no-sidebar"', 'div class=with-header', 'div id="search-page"',
                                     'div class="cookie-ok"', 'div class="banner"', 'form><div class="search"'])
@pytest.mark.parametrize("inner", ["article", "main", 'div class="entry-content"'])
def test_plain_wrapper_of_the_whole_page(weights, wrapper, inner):
    body = AROUND % f"<{inner}>{ARTICLE}</{inner.split()[0]}>"
    page = f"<html><body><{wrapper}>{body}</div></form></body></html>"
    assert htmlcut.main_text(page, weights)[0].split("\n") == WANT


def test_form_around_a_page_without_article(weights):
    page = f"<body><form><nav><a href=1>One</a></nav><div>{ARTICLE}</div><footer>&copy; 2020</footer></form></body>"
    assert htmlcut.main_text(page, weights)[0].split("\n") == WANT


def test_plain_elements_that_wrap_no_page(weights):
    comments = "".join(f'<article class="comment"><p>{LONG}</p></article>' for _ in range(9))
    page = f'<body><article>{ARTICLE}</article><div id="comments">{comments}</div><form class="signup"><p>{LONG}</p></form></body>'
    assert htmlcut.main_text(page, weights)[0].split("\n") == WANT
    assert htmlcut.main_text(f'<body><div id="comments">{comments}</div></body>', weights)[0] == ""
    assert htmlcut.main_text(f"<body><aside><article><p>{LONG}</p></article></aside></body>", weights)[0] == ""


def test_many_wrappers_are_linear(weights):
    t = time.time()
    assert "Title of it" in htmlcut.main_text("<form>" * 30_000 + ARTICLE, weights)[0]
    assert time.time() - t < 10
