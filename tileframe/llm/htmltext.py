"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags; a linear classifier gives each block the cost of calling it boilerplate or
content, which become its capacities from the source and to the sink. Blocks next to each other are joined by an edge whose capacity
falls with their distance in the element tree, and blocks under one parent by another. The maximum flow (Dinic) leaves the minimum
cut: blocks still reached from the source are the article.

The classifier has two parts. What the markup says is given: scripts, styles, forms, menus, page headers, footers, sidebars, notices,
adverts, reader comments and hidden elements are boilerplate for certain (by tag, role, class or id), article and main speak for content.
What the text says (words, share of links, sentence ends, headings, copyright signs, place) has weights that are trained: logistic
regression in numpy on blocks of a bounded sample of pages, labelled by their markup, drawn towards WEIGHTS where labels are few.

Each page is read whole and on its own, so there is no shuffle; the longest page bounds a task's memory. NULL and empty pages have an
empty text; repeated ids and pages are rows each; an empty table gives no rows. Broken markup is taken as browsers take it: open
tags at the end are dropped, missing end tags are put in, elements deeper than 512 belong to the one around them.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tileframe.llm.common import slices

#: Pages and blocks that the text weights are fitted on, at most (pages: about).
SAMPLE_PAGES = 2000
SAMPLE_BLOCKS = 20_000
#: Bytes of html that are worked on at once; a longer page is alone.
SLICE_BYTES = 1 << 20
DEEPEST = 512

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
SPEAKING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop)\b", re.I)

RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NO_BLOCK = {"html", "head", "meta", "link", "base"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose start ends an open element of the same kind within the nearest of these.
CLOSED_BY_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
KINDS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

BOILERPLATE_TAGS = set("nav aside form button select dialog menu footer template noscript svg math canvas object audio video map datalist".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar comment tablist".split())
COMMENT_WORDS = set("comment comments commentlist disqus respond replies reply discussion related recommended recommendations".split())
BOILERPLATE_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead topbar ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social toolbar pagination pager notice notices banner alert disclaimer copyright skip".split()
)
ARTICLE_WORDS = set("article entry post story main".split())
BODY_WORDS = set("body content text".split())
NEGATIONS = {"no", "not", "has", "with", "without", "is", "hide"}

FEATURES = ("one", "log words", "sentence end", "share of links", "heading", "copyright", "place")
#: Weights of FEATURES that training starts from and is drawn to: log-odds of content.
WEIGHTS = (-1.8, 0.9, 0.8, -4.0, 1.0, -2.0, 0.0)
INSIDE, OUTSIDE, UNMARKED, NESTED = 3.0, -3.0, 1.3, -6.0
NEXT, SIBLING = 1.2, 0.8
UNIT = 100
CERTAIN = 1 << 40


@lru_cache(maxsize=50_000)
def spoken(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element says of itself: 0 nothing, 1 boilerplate by name, 2 comments by name, 3 boilerplate for certain; and whether it is an article."""
    certain, words, article = tag in BOILERPLATE_TAGS, [], tag in ("article", "main")
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words += [w for one in value.split() for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", one).lower()) if w]
        elif name == "role":
            certain |= value.strip().lower() in BOILERPLATE_ROLES
            article |= value.strip().lower() in ("main", "article")
        elif name == "itemprop":
            article |= value.strip().lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            certain = True
        elif name == "style":
            certain |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()))
    if certain:
        return 3, False
    if tag in ("html", "body"):
        return 0, False
    meant = [w for before, w in zip(["", *words], words, strict=False) if before not in NEGATIONS]
    if set(meant) & COMMENT_WORDS:
        return 2, False
    if set(meant) & BOILERPLATE_WORDS or "header" in meant and not set(meant) & ARTICLE_WORDS:
        return (0, True) if tag in ("article", "main") else (1, False)
    return 0, article or tag in ("div", "section") and bool(set(meant) & ARTICLE_WORDS and set(meant) & BODY_WORDS or "articlebody" in meant)


@dataclass
class Block:
    element: int
    depth: int
    heading: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    near: int = 0
    text: str = ""


class Page:
    """The blocks of a page in order and its elements: parent, what each says of itself, and whether it is an article."""

    def __init__(self, source: str):
        self.parent, self.says, self.article, self.names = [-1], [0], [False], [""]
        self.blocks: list[Block] = []
        self.stack: list[int] = [0]
        self.open: dict[str, int] = {}
        self.block: Block | None = None
        self.low = 1
        self.links = 0
        self.read(source)
        self.end_block()

    def read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                return
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                self.boundary(tag)
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = closing.end() if closing else n
            elif m.end() < n or source[-1] == ">":
                self.start(tag, m[3])

    def text(self, piece: str) -> None:
        if self.block is None:
            if not piece.strip():
                return
            self.block = Block(self.stack[-1], len(self.stack), any(self.names[e] in HEADINGS for e in self.stack[-4:]))
            self.block.near = max(0, len(self.stack) - self.low) + max(0, (self.blocks[-1].depth if self.blocks else len(self.stack)) - self.low)
        piece = html.unescape(piece) if "&" in piece else piece
        self.block.pieces.append(piece)
        if self.links:
            self.block.linked += len("".join(piece.split()))

    def end_block(self) -> None:
        if self.block is not None:
            self.block.text = " ".join("".join(self.block.pieces).split())
            self.block.pieces = []
            if self.block.text:
                self.blocks.append(self.block)
                self.low = len(self.stack)
            self.block = None

    def boundary(self, tag: str) -> None:
        if tag not in INLINE and tag not in NO_BLOCK and tag not in ("script", "style", "br"):
            self.end_block()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.block is not None:
                self.block.pieces.append(" ")
            return
        self.boundary(tag)
        if tag in VOID or tag in NO_BLOCK:
            return
        if tag not in INLINE and self.open.get("p"):
            self.close(("p",), {"table", "td", "th", "button"})
        if tag in CLOSED_BY_OWN:
            self.close(KINDS.get(tag, (tag,)), CLOSED_BY_OWN[tag])
        if len(self.stack) >= DEEPEST:
            return
        said, article = spoken(tag, attributes if SPEAKING.search(attributes) else "")
        self.parent.append(self.stack[-1])
        self.says.append(said)
        self.article.append(article)
        self.names.append(tag)
        if said and tag in INLINE:  # an inline advert is a block of its own
            self.end_block()
        self.stack.append(len(self.parent) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"

    def close(self, tags: tuple[str, ...], bounds: set[str]) -> None:
        """Ends the nearest open element of one of tags, unless one of bounds is nearer."""
        if any(self.open.get(t) for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.names[self.stack[i]]
                if name in tags:
                    self.pop(i)
                    return
                if name in bounds:
                    return

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
            return
        self.boundary(tag)
        if self.open.get(tag):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.names[self.stack[i]] == tag:
                    self.pop(i)
                    return

    def pop(self, i: int) -> None:
        for e in self.stack[i:]:
            self.open[self.names[e]] -= 1
            self.links -= self.names[e] == "a"
            if self.says[e] and self.names[e] in INLINE:
                self.end_block()
        del self.stack[i:]
        self.low = min(self.low, i)

    def judged(self) -> tuple[list[bool], list[float]]:
        """Of each element: boilerplate for certain, and what its markup adds to the score of its text."""
        n = len(self.parent)
        size, inside = [0] * n, [False] * n
        for b in self.blocks:
            size[b.element] += len(b.text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
        for e in range(1, n):
            inside[e] = self.article[e] or inside[self.parent[e]]
        # A wrapper with the largest article in it, or with most of the text if there is none, is named after something beside the article.
        articles = [e for e in range(1, n) if self.article[e]]
        wrapper, e = set(), max(articles, key=lambda e: (size[e], -e), default=0)
        while e:
            wrapper.add(e)
            e = self.parent[e]
        if not articles:
            wrapper = {e for e in range(1, n) if 2 * size[e] > size[0]}
        certain, extra = [False] * n, [0.0] * n
        extra[0] = OUTSIDE if any(size[e] for e in articles) else UNMARKED
        for e in range(1, n):
            p = self.parent[e]
            header = self.names[e] == "header" and not inside[e]
            certain[e] = certain[p] or self.says[e] >= 2 or self.says[e] == 1 and e not in wrapper or header
            extra[e] = extra[p]
            if self.article[e]:
                extra[e] = NESTED if inside[p] and self.names[e] == "article" and any_article(self, p) else INSIDE
        return certain, extra


def any_article(page: Page, e: int) -> bool:
    """Whether an element or one around it is an article element."""
    while e:
        if page.names[e] == "article":
            return True
        e = page.parent[e]
    return False


def features(page: Page) -> np.ndarray:
    """Blocks x FEATURES."""
    rows = []
    for i, b in enumerate(page.blocks):
        letters = max(1, len(b.text) - b.text.count(" "))
        rows.append((1.0, np.log1p(b.text.count(" ") + 1), b.text[-1] in ".!?…:;\"”»'", min(1.0, b.linked / letters), b.heading, "©" in b.text, i / len(page.blocks)))
    return np.array(rows, "float64").reshape(-1, len(FEATURES))


def content_side(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes a minimum cut leaves on the source's side (of several cuts, the one with the fewest).

    costs: capacity from the source if positive, to the sink if negative; edges: two nodes and a capacity in both directions.
    """
    n = len(costs)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def edge(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0)
        elif c < 0:
            edge(i, sink, -c, 0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                first = 0
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= least
                    room[path[k] ^ 1] += least
                    if not room[path[k]]:
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def article_text(source: str, weights: np.ndarray) -> str:
    """The content blocks of a page, one a line."""
    page = Page(source)
    certain, extra = page.judged()
    score = features(page) @ weights
    costs = [-CERTAIN if certain[b.element] else round(UNIT * (score[i] + extra[b.element])) for i, b in enumerate(page.blocks)]
    edges, last = [], {}
    for i, b in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, max(1, round(UNIT * NEXT / (1 + b.near / 2)))))
        around = page.parent[b.element] if b.element else 0
        if around in last and last[around] != i - 1:
            edges.append((last[around], i, round(UNIT * SIBLING)))
        last[around] = i
    return "\n".join(b.text for b, kept in zip(page.blocks, content_side(costs, edges), strict=True) if kept)


def fit_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_blocks: int = SAMPLE_BLOCKS, pull: float = 5.0, steps: int = 50) -> np.ndarray:
    """Weights of FEATURES by penalised logistic regression (Newton steps) on blocks of about sample_pages pages, told by a hash of
    their ids, and of those at most sample_blocks blocks by a hash; blocks in articles are content, certain boilerplate isn't, others
    are left out. pull: weight of WEIGHTS in label counts."""
    n = pages.count()
    known = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(html_col).alias("html"))
    known = known.where(F.pmod("h", F.lit(1_000_000)) < max(1, round(1e6 * min(1.0, sample_pages / max(1, n)))))
    schema = pa.schema([("h", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            h, x, y = [], [], []
            for key, source in zip(batch.column("h").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source)
                certain, extra = page.judged()
                told = [0.0 if certain[b.element] else 1.0 if extra[b.element] == INSIDE else None for b in page.blocks]
                for i, row in enumerate(features(page).tolist()):
                    if told[i] is not None:
                        h.append(key)
                        x.append(row)
                        y.append(told[i])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], schema=schema)

    rows = known.mapInArrow(run, "h bigint, x array<double>, y double")
    got = rows.orderBy(F.xxhash64("h", "x"), "x", "y").limit(sample_blocks).collect()
    prior = np.array(WEIGHTS)
    if not got:
        return prior
    x, y, w = np.array([r.x for r in got]), np.array([r.y for r in got]), prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (y - p) - pull * (w - prior))
        w = w + change
        if np.abs(change).max() < 1e-9:
            break
    return np.round(w, 6)


def extract_text(pages: DataFrame, weights: np.ndarray, keep: list[str], html_col: str = "html", name: str = "text") -> DataFrame:
    """The columns of keep and the main text of each page."""
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            texts = pa.array([article_text(source, weights) for source in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], name])

    return rows.mapInArrow(run, schema).toDF(*keep, name)
