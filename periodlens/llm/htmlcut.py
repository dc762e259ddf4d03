"""Main text of web pages by minimum cut (operator 1).

A page becomes a list of text blocks with their place in the document tree.  A
classifier gives each block a log-odds of being content: fixed hints of the
tree (element names, class and id words) plus a logistic model of the text's
shape, fitted on a bounded sample of pages whose tree labels the blocks.  The
log-odds are terminal capacities; neighbours in page order and in the tree are
joined by smoothness edges; the minimum cut separates content from the rest.
Every page is one small graph, solved inside a task.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, unused

# Element names of the HTML standard by the role they play here.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "object", "canvas", "audio", "video", "title", "head", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr", "ruby", "rt", "rp", "input", "link", "meta", "param", "source", "track"}
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
CONTENT_TAGS = {"article", "main"}
PLAIN_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "address"}
CONTENT_NAMES = {"article", "content", "main", "post", "entry", "story", "maincontent"}
PLAIN_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "promo", "promotion", "sponsor", "sponsored", "banner", "nav", "navbar", "navigation", "menu", "sidebar",
               "footer", "header", "masthead", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "respond", "reply", "replies", "share", "sharing", "social",
               "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter",
               "subscribe", "signup", "login", "search", "searchbox", "pagination", "pager", "widget", "copyright", "disclaimer", "toolbar", "skip", "complementary",
               "contentinfo", "hidden", "teaser", "outbrain", "taboola", "disqus", "trending", "form", "aside"}
#: Plain elements that no page puts its article in; any other may wrap the whole page.
NEVER_WRAP = {"nav", "footer", "aside", "menu", "address"}
#: A name that begins or ends so says what else the page has, or which page it is: 'has-sidebar', 'search-page'.
STATES, PAGE_STATES = {"has", "have", "no", "not", "non", "with", "without"}, {"page", "layout", "ok", "accepted", "enabled", "disabled"}

STRONG, WEAK = 8.0, 3.0  # log-odds of a hint of the tree; of lying outside the article of a page that has one
TEXT_LIMIT = 2.5  # at most so much from the text's shape
ADJACENT, KIN = 0.6, 0.5  # smoothness between neighbours in page order; between neighbours in one parent or grandparent
#: Pages, and characters of each, that teach the model of text shapes at most.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    hint: float = 0.0  # of this element and those above it
    article: bool = False
    plain: bool = False  # by its own name and attributes
    content: bool = False
    fresh: bool = False  # content, and nothing about it is plain


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link_chars: int
    cells: list = field(default_factory=list)


def _kind(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is plain, is content, and is content without a plain word, by its name and attributes."""
    plain, content = tag in PLAIN_TAGS, tag in CONTENT_TAGS
    if tag in ("body", "html"):  # their classes describe the whole page
        return False, False, False
    if not attributes or plain:
        return plain, content, content and not plain
    plain_word = content_word = False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _WORDS.findall(name)
            if not parts or parts[0] in STATES:
                continue
            plain_word |= parts[-1] not in PAGE_STATES and not PLAIN_NAMES.isdisjoint(parts)
            content_word |= not CONTENT_NAMES.isdisjoint(parts)
    plain_word |= bool(_HIDDEN.search(attributes))
    if content:
        return False, True, not plain_word
    return plain_word, content_word, content_word and not plain_word


def _hint(node: Node, plain: bool) -> tuple[float, bool]:
    """Log-odds of an element, below what lies above it: a plain element inside the article is plain, an article
    inside a plain element is not content."""
    parent = node.parent
    if parent.hint < 0 or plain:
        return -STRONG, parent.article
    return (STRONG if node.content or parent.hint > 0 else 0.0), parent.article or node.content


def _unwrap(nodes: list[Node], out: list[Block]) -> None:
    """If nothing is content because a plain element wraps the page, the wrapper gives no hint.

    A wrapper holds more than half of the text (menus, footers and links aside), and is a form or has a content
    element in it that is not plain itself (as comments in a list of comments are)."""
    weight: dict[int, int] = {}  # by element: text in it
    fresh: set[int] = set()
    never: set[int] = set()
    for x in nodes:  # outer elements come first
        if id(x.parent) in never or x.plain and (x.tag in NEVER_WRAP):
            never.add(id(x))
    total = 0
    for b in out:
        if id(b.node) not in never:
            own = max(0, len(b.text) - b.link_chars)
            weight[id(b.node)] = weight.get(id(b.node), 0) + own
            total += own
    for x in reversed(nodes):
        if id(x) in weight:
            weight[id(x.parent)] = weight.get(id(x.parent), 0) + weight[id(x)]
        if x.fresh or id(x) in fresh:
            fresh.add(id(x.parent))
    for x in nodes:
        wraps = x.plain and not x.parent.article and 2 * weight.get(id(x), 0) > total and (x.tag == "form" or id(x) in fresh)
        x.hint, x.article = _hint(x, x.plain and not wraps)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    root = Node("", None)
    node, out, parts = root, [], []
    nodes: list[Node] = []
    link, link_chars = 0, 0
    at, n, last = 0, len(page), page.rfind(">")

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, node, link_chars))
            parts.clear()
        link_chars = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            link_chars += (lt - at) if link else 0
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if lt > last:  # no tag ends after this: text
            parts.append(page[lt:])
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
            else:
                parts.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        if not closing and tag in SKIPPED:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag == "head":  # never closed: the body starts it off
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                else:
                    at = n
            parts.append(" ")
            continue
        flush()
        if closing:
            up = node
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                node, link = up.parent, 0
            continue
        if tag in VOID:
            continue
        if node.tag in CLOSED_BY_BLOCK:
            node = node.parent
        if tag in CLOSED_BY_SAME:
            up = node
            while up is not root and up.tag != tag and up.tag not in CLOSED_BY_SAME[tag]:
                up = up.parent
            if up.tag == tag:
                node = up.parent
        if not attributes.rstrip().endswith("/") or tag not in VOID:
            node = Node(tag, node, 0.0, False, *_kind(tag, attributes))
            node.hint, node.article = _hint(node, node.plain)
            nodes.append(node)
    flush()
    if out and not any(b.node.hint > 0 for b in out) and any(x.plain for x in nodes):
        _unwrap(nodes, out)
    return out


# ------------------------------------------------------------ classifier
def shape(block: Block) -> list[float]:
    """Features of a block's text that do not depend on its place."""
    t = block.text
    n = len(t)
    words = t.count(" ") + 1
    marks = sum(map(t.count, ".!?"))
    return [1.0, min(words, 60) / 20, float(words >= 12), min(1.0, block.link_chars / n), float(t[-1] in ".!?\"'”’"), min(1.0, 10 * marks / words),
            float("©" in t or "®" in t), float(block.node.tag in ("p", "blockquote", "pre")), float(block.node.tag in ("h1", "h2", "h3")),
            float(block.node.tag in ("li", "td", "th"))]


#: What the model knows before it sees a page, in the order of ``shape``; fitting moves it only as far as the sample asks.
PRIOR = np.array([-1.0, 0.6, 0.6, -3.0, 0.6, 0.4, -2.0, 0.8, 0.4, -0.6])


def fit(pages: DataFrame, html_col: str = "html") -> np.ndarray:
    """Weights of ``shape``: logistic regression, pulled towards ``PRIOR``, on the ``SAMPLE_PAGES`` pages with
    the least content hashes.  Labels are the hints of the tree; blocks without a hint have no label."""
    rows = pages.select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("x")).where("h is not null")
    # the hashes first, so that only the chosen pages leave their tasks
    last = rows.select("x").distinct().orderBy("x").limit(SAMPLE_PAGES).agg(F.max("x")).first()[0]
    sample = rows.where(F.col("x") <= (last or 0)).groupBy("x").agg(F.min(F.substring("h", 1, SAMPLE_CHARS)).alias("h")).orderBy("x")
    x, y = [], []
    for r in sample.collect():
        for b in blocks(r["h"]):
            if b.node.hint:
                x.append(shape(b))
                y.append(b.node.hint > 0)
    w = PRIOR.copy()
    if x:
        a, t = np.array(x), np.array(y, float)
        for _ in range(25):  # Newton steps
            p = 1 / (1 + np.exp(-(a @ w)))
            curve = (a * (p * (1 - p))[:, None]).T @ a / len(t) * 100 + np.eye(len(w))
            w = w + np.linalg.solve(curve, a.T @ (t - p) / len(t) * 100 - (w - PRIOR))
    return w


def odds(page: list[Block], weights: np.ndarray) -> list[float]:
    """Log-odds of content of each block."""
    has_article = any(b.node.article for b in page)
    text = np.clip(np.array([shape(b) for b in page]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    return [float(t) + (b.node.hint or (-WEAK if has_article else 0.0)) for b, t in zip(page, text)]


def edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between blocks: adjacency in page order, and consecutive blocks of a parent and of a grandparent."""
    out: dict[tuple[int, int], float] = {}
    for i in range(len(page) - 1):
        out[i, i + 1] = ADJACENT
    for up in (0, 1):
        before: dict[int, int] = {}
        for i, b in enumerate(page):
            parent = b.node.parent or b.node
            place = id(parent if up == 0 else parent.parent or parent)
            if place in before:
                key = (before[place], i)
                out[key] = out.get(key, 0.0) + KIN / (1 + up)
            before[place] = i
    return out


# ----------------------------------------------------------- minimum cut
def minimum_cut(gain: list[float], smooth: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the sum of |gain| of blocks labelled against its sign and of
    the smoothness of edges between different labels; the fewest blocks are content
    among equal cuts.

    A block whose gain outweighs all its edges has its label in every minimum cut; it is
    fixed and its edges become gains of its neighbours.  Maximum flow (Dinic) labels the rest.
    """
    n = len(gain)
    u = [round(g * 4096) for g in gain]
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), w in smooth.items():
        c = round(w * 4096)
        if i != j and c > 0:
            around[i][j] = around[i].get(j, 0) + c
            around[j][i] = around[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    weight = [sum(a.values()) for a in around]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or not (u[i] > weight[i] or -u[i] >= weight[i]):
            continue
        label[i] = u[i] > 0
        for j, c in around[i].items():
            if label[j] is None:
                u[j] += c if label[i] else -c
                weight[j] -= c
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _dinic(rest, u, around, label)
    return [bool(x) for x in label]


def _dinic(rest: list[int], u: list[int], around: list[dict[int, int]], label: list[bool | None]) -> None:
    number = {i: k for k, i in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def add(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, k in number.items():
        if u[i] > 0:
            add(s, k, u[i], 0)
        elif u[i] < 0:
            add(k, t, -u[i], 0)
        for j, c in around[i].items():
            if j > i and j in number:
                add(k, number[j], c, c)
    while True:
        level = [-1] * (len(rest) + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            for i, k in number.items():
                label[i] = level[k] >= 0
            return
        at = [0] * (len(rest) + 2)
        path: list[int] = []
        a = s
        while True:  # a blocking flow, without recursion
            if a == t:
                most = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= most
                    cap[e ^ 1] += most
                first = next(i for i, e in enumerate(path) if cap[e] == 0)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def main_text(page: str, weights: np.ndarray) -> tuple[str, int, int]:
    """(text, blocks, content blocks) of one page."""
    own = blocks(page)
    if not own:
        return "", 0, 0
    content = minimum_cut(odds(own, weights), edges(own))
    return "\n".join(b.text for b, c in zip(own, content) if c), len(own), sum(content)


def extract(pages: DataFrame, html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` with the columns ``text``, ``n_blocks`` and ``n_content`` (existing ones of
    these names are replaced) and without ``html_col``.

    Blocks are decoded, their white space is one space each, and they are joined by a line
    feed in page order.  Null, empty and text-free pages give the empty text.  Other columns
    are carried unchanged; rows may repeat; an empty table gives no rows.
    """
    weights = fit(pages, html_col) if weights is None else weights
    added = ["text", "n_blocks", "n_content"]
    kept = [c for c in pages.columns if c != html_col and c not in added]
    name = unused("__html_bytes", kept)
    keyed = pages.select(*[F.col(f"`{c}`") for c in kept], as_bytes(F.col(f"`{html_col}`")).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, name):
            done = [main_text(t.decode("utf-8", "replace"), weights) for t in b.column(b.num_columns - 1).to_pylist()]
            new = [pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *new], names=[*kept, *added])

    schema = keyed.drop(name).schema.add("text", "string").add("n_blocks", "long").add("n_content", "long")
    return keyed.mapInArrow(run, schema)
