"""Main text of web pages by minimum cut.

A page is cut into blocks at block-level tags.  Each block has a cost of being
called content and one of being called boilerplate; they are the terminal
capacities of a flow network.  Neighbours in page order and neighbours under one
parent are joined by smoothness edges, which weigh more the closer the blocks
stand in the DOM.  The minimum cut gives the cheapest labelling.

Costs.  A block's cost is the sum of three bounded parts:

* its text: a logistic classifier over words, links, punctuation and tag, between
  ``-TEXT`` and ``TEXT``;
* the mark: for standing in a marked article, against standing outside of one on
  a page that marks its article;
* cues of its containers: strong ones for a tag, role or whole class name that
  says menu, footer, advert and so on, weak ones for parts of a compound name
  (``with-sidebar``) that say so, up to two.

The mark weighs a little more than the text, and a strong cue more than both with
all neighbours; what lies between is left to the neighbours.  Where a page's only
articles stand in named containers, those names describe the page's layout and
don't count; names inside the article do.

The classifier is fitted on the first ``SAMPLE_BLOCKS`` blocks of pages that mark
their article: its label is where the block stands, its features don't show the
mark.  Without such pages its weights are ``START``.

Text.  Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space in page order.

Edge cases.  Null and empty pages, and pages of boilerplate only, give an empty
text; an empty table gives an empty result.  Markup cut off by the page's end is
dropped; a tag with an unclosed quote ends at the next ``>``; unclosed elements
end with their parent.  Ties of the cut are boilerplate.  Repeated rows are
treated alike.  Other columns are not read.  Pages are read to their end.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BLOCKS = 5000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>"'<]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>"'<]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPAQUE = frozenset("script style noscript template iframe object svg math textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = frozenset("nav aside footer form menu dialog button".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising aside author-box banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
OF_ARTICLES = frozenset("ad ads advert comment comments promo related replies reply sponsored teaser".split())
"""Names that count on an article element, too."""
TEXT = 4.5
"""Bound of the text's part of a block's cost."""
SMOOTH = 7.0
"""Weight of an edge between blocks of one element; it halves with each step between them in the DOM."""
START = (-2.0, 1.2, -4.0, 1.5, 2.0, -0.5, 6.0, -18.0, -1.5)
"""Bias, log of words, share of words in links, ends as a sentence, heading, list item; then mark, strong cues, weak cues, which stay as they are."""
FITTED = 6
PENALTY = 10.0
"""Of leaving ``START``, in the fit."""


class Cues(NamedTuple):
    """What the containers of a block say; counts."""

    tags: int = 0
    """Tags and roles of boilerplate."""
    hidden: bool = False
    above: tuple[int, int] = (0, 0)
    """Strong and weak names above the innermost article; all names, if there is none."""
    within: tuple[int, int] = (0, 0)
    """Strong and weak names inside the innermost article."""
    article: bool = False
    """In a marked article or main part."""


@dataclass
class Block:
    text: str
    n_words: int
    link_words: int
    tag: str
    path: tuple[int, ...]
    cues: Cues


@dataclass
class _Element:
    tag: str
    number: int
    cues: Cues


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    clear_article: bool = False
    """Some article stands in no named container."""


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _names(found: dict[str, str], known: frozenset[str], parts: bool = True) -> tuple[int, int]:
    """How many whole class or id names are known, and how many hold a known part."""
    strong = weak = 0
    for token in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        if token in known:
            strong += 1
        elif parts and not known.isdisjoint(re.split("[_-]+", token)):
            weak += 1
    return strong, weak


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))


def _sum(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], a[1] + b[1]


def _below(parent: Cues, tag: str, found: dict[str, str]) -> Cues:
    """Cues of an element's content, from those around it."""
    role = found.get("role", "").lower()
    bad = tag in BAD_TAGS or tag in ("head", "title") or tag == "header" and not parent.article or role in BAD_ROLES
    tags, hidden = parent.tags + bad, parent.hidden or _hidden(found)
    article = tag in ("article", "main") or role in ("article", "main") or found.get("itemprop", "").lower() == "articlebody"
    if article and not (tag != "main" and _names(found, OF_ARTICLES)[0]):
        # names around a new article are above it from now on
        return Cues(tags, hidden, _sum(parent.above, parent.within), (0, 0), True)
    named = (0, 0) if tag in ("html", "body") else _names(found, BAD_NAMES, parts=not article)
    if parent.article:
        return Cues(tags, hidden, parent.above, _sum(parent.within, named), True)
    return Cues(tags, hidden, _sum(parent.above, named), (0, 0), False)


def read_blocks(page: str) -> _Page:
    """Blocks of a page in order; each knows its containers."""
    out = _Page()
    stack: list[_Element] = [_Element("", 0, Cues())]
    counter = 0
    pieces: list[str] = []
    links: list[str] = []
    tag_of_block = ""

    def flush() -> None:
        nonlocal tag_of_block
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                top = stack[-1]
                tags = [e for e in stack if e.tag and e.tag not in INLINE]
                own = tag_of_block or (tags[-1].tag if tags else "")
                n_links = len(html.unescape(" ".join(links)).split())
                out.blocks.append(Block(" ".join(words), len(words), min(n_links, len(words)), own, tuple(e.number for e in tags), top.cues))
            pieces.clear()
            links.clear()
        tag_of_block = ""

    at, n = 0, len(page)
    in_link = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            raw = page[at : m.start()]
            pieces.append(raw)
            if in_link:
                links.append(raw)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            if not closing:
                found = _attributes(rest) if rest else {}
                if not (_names(found, BAD_NAMES)[0] or _hidden(found)) or rest.endswith("/"):
                    continue
            elif not any(e.tag == tag for e in stack[-8:]):
                continue
        elif tag == "br":
            pieces.append(" ")
            continue
        elif tag in VOID:
            if tag == "hr":
                flush()
            continue
        elif tag in OPAQUE:
            if not closing and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            pieces.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            in_link = 0 if tag not in INLINE else in_link
            continue
        if rest.endswith("/"):
            continue
        # elements that a block-level start ends
        if tag not in INLINE:
            if tag == "body" or stack[-1].tag == "head" and tag not in ("title", "head"):
                while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                    stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                e = stack[i].tag
                if e == "p" or e == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    del stack[i:]
                    break
                if e not in INLINE:
                    break
        cues = _below(stack[-1].cues, tag, _attributes(rest) if rest else {})
        counter += 1
        out.clear_article |= cues.article and not (cues.tags or cues.hidden or cues.above[0] or cues.within[0])
        stack.append(_Element(tag, counter, cues))
    if at < n:
        pieces.append(page[at:])
    flush()
    return out


def features(page: _Page, b: Block) -> tuple[float, ...]:
    cues = b.cues
    mark = (1.0 if cues.article else -1.0) if cues.article or page.clear_article else 0.0
    # names above a page's only articles describe its layout
    strong = cues.tags + cues.within[0] + (cues.above[0] if page.clear_article or not cues.article else 0)
    weak = cues.within[1] + (0 if cues.article else cues.above[1])
    containers = (mark, 2.0 if cues.hidden else float(min(strong, 1)), float(min(weak, 2)))
    return (1.0, math.log1p(b.n_words), b.link_words / b.n_words, float(b.text[-1] in ".!?…\"'»”"), float(b.tag in HEADINGS), float(b.tag in ("li", "dt", "dd")), *containers)


def _closeness(a: Block, b: Block) -> float:
    """Smoothness between two blocks: more for those that share more of their containers."""
    shared = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        shared += 1
    apart = len(a.path) + len(b.path) - 2 * shared
    return SMOOTH * 0.5**apart


def cost(page: _Page, b: Block, weights: tuple[float, ...] = START) -> float:
    """What calling the block boilerplate costs more than calling it content."""
    terms = [w * x for w, x in zip(weights, features(page, b), strict=True)]
    return max(-TEXT, min(TEXT, sum(terms[:FITTED]))) + sum(terms[FITTED:])


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: neighbours in page order, and neighbours under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = _closeness(blocks[i - 1], b)
        parent = b.path[-2] if len(b.path) > 1 else 0
        j = last_of.get(parent)
        if j is not None and j != i - 1:
            edges[j, i] = _closeness(blocks[j], b)
        last_of[parent] = i
    return edges


def label(page: _Page, weights: tuple[float, ...] = START) -> list[bool]:
    """Whether each block is content: the minimum cut."""
    return min_cut([cost(page, b, weights) for b in page.blocks], edges_of(page.blocks))


def min_cut(net: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the sum of wrong labels' costs and of cut edges.

    net[i] > 0 is the cost of calling i boilerplate, -net[i] > 0 that of calling it
    content.  Blocks whose cost exceeds all their edges are settled first; the rest
    is a maximum flow.  Ties are boilerplate.
    """
    n = len(net)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    net = list(net)
    out: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if out[i] is not None or abs(net[i]) <= sum(near[i].values()):
            continue
        out[i] = net[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            net[j] += w if out[i] else -w
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if out[i] is None]
    if rest:
        # residual capacities: source -> content, boilerplate -> sink
        source, sink = n, n + 1
        cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest}
        cap[source], cap[sink] = {}, {}
        for i in rest:
            if net[i] > 0:
                cap[source][i], cap[i][source] = net[i], 0.0
            else:
                cap[i][sink], cap[sink][i] = -net[i], 0.0
        while True:
            level = {source: 0}
            queue = deque([source])
            while queue:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-12 and v not in level:
                        level[v] = level[u] + 1
                        queue.append(v)
            if sink not in level:
                break
            ways = {u: iter(list(cap[u])) for u in level}
            path = [source]
            while path:
                u = path[-1]
                if u == sink:
                    flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                    for a, b in zip(path, path[1:], strict=False):
                        cap[a][b] -= flow
                        cap[b][a] = cap[b].get(a, 0.0) + flow
                    cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] <= 1e-12)
                    path = path[: cut + 1]
                    continue
                v = next(ways[u], None)
                if v is None:
                    path.pop()
                elif level.get(v) == level[u] + 1 and cap[u][v] > 1e-12:
                    path.append(v)
        for i in rest:
            out[i] = i in level
    return [bool(x) for x in out]


def main_text(page: str | None, weights: tuple[float, ...] = START) -> str:
    if not page:
        return ""
    read = read_blocks(page)
    return " ".join(b.text for b, content in zip(read.blocks, label(read, weights), strict=True) if content)


def fit(pages: DataFrame, *, html_col: str = "html", sample_blocks: int = SAMPLE_BLOCKS) -> tuple[float, ...]:
    """Weights of the classifier, from at most ``sample_blocks`` blocks of pages that mark their article."""
    marked = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for page in part.column(0).to_pylist():
                read = read_blocks(page)
                # what stands in an article below a name may belong to it or not
                blocks = [b for b in read.blocks if read.clear_article and not (b.cues.article and (b.cues.tags or b.cues.hidden or b.cues.above[0] or any(b.cues.within)))]
                yield pa.RecordBatch.from_arrays([pa.array([features(read, b)[:FITTED] for b in blocks], pa.list_(pa.float64())), pa.array([b.cues.article for b in blocks], pa.bool_())], names=["x", "y"])

    # only the numbers of a bounded count of blocks come back; partitions are tried one after another until there are enough
    rows = marked.mapInArrow(run, "x array<double>, y boolean").take(sample_blocks)
    if len({r.y for r in rows}) < 2:
        return START
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    start = np.array(START[:FITTED])
    w = start.copy()
    for _ in range(25):  # Newton steps with a quadratic penalty around the start
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + PENALTY * (w - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return (*(float(v) for v in w), *START[FITTED:])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] | None = None, sample_blocks: int = SAMPLE_BLOCKS) -> DataFrame:
    """Per page: id, url, text, n_chars."""
    weights = weights or fit(pages, html_col=html_col, sample_blocks=sample_blocks)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [main_text(page, weights) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{kind}, text string, n_chars long").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
