"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block-level tags.  Every block has its word
count and link density, those of the blocks before and after it, and a few
marks of its surroundings (inside an article or main element, inside other
matter, heading, paragraph, list item, sentence end).  A decision tree, trained
on the small labelled table of ``html_training``, says which blocks are main
text.

Other matter is marked by element (menu, footer, form, ...) or by a class, id
or role of one to three parts, one of which names such matter; states and
topics (``has-sidebar``, ``tag-legal``, ``side-effects-of-x``) name none.  A mark
holds for all blocks inside, unless the element has the page's article or main
element in it, or, for names that layouts use freely, most of the page's words
(and is no part of the main text).
Article and main elements are marked by reader comments only.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by a line feed.  Scripts, styles and comments are no
text.  Null or empty html gives an empty text; broken markup is read as far as
it goes: an open comment, script or style runs to the end, any other element
without text that is not closed ends at the next block.  Very long pages are
read whole; repeated rows are each returned; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_training import labelled_pages
from .text import pieces

# Element names.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "title", "select",
       "canvas", "audio", "video", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img", "br", "ruby", "rb", "rt", "rp", "nobr", "picture", "source", "track",
          "map", "area", "meter", "progress", "output"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "param", "source", "track"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "fieldset", "legend", "option", "label",
         "input", "head"}
MAIN = {"article", "main"}
FIRM_TAGS = {"nav", "footer", "aside", "menu", "dialog"}
OPEN_ENDED = {"script", "style"}
# Words of class names, ids and roles.
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
FIRM_WORDS = COMMENT_WORDS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "outbrain", "taboola",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "share", "sharing", "social", "related", "recommended", "recommendations", "copyright", "disclaimer", "breadcrumb",
    "breadcrumbs", "pagination", "pager"}
LAYOUT_WORDS = {"promotion", "banner", "sidebar", "aside", "rail", "nav", "navbar", "navigation", "menu", "header", "masthead", "footer",
                "foot", "form", "search", "widget", "widgets", "toolbar", "contentinfo", "complementary", "dialog", "announcement", "toc",
                "discussion"}
# names of other matter only when they stand alone
LONE_WORDS = {"side", "legal", "tags", "notice", "notices", "alert", "skip"}
TOP_WORDS = {"header", "masthead"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "body", "articlebody", "maincontent", "text"}
# a name that begins like this tells a state or a topic
TOPICS = ("has-", "with-", "without-", "no-", "not-", "is-", "hide-", "show-", "tag-", "category-", "cat-", "type-", "format-", "status-",
          "single-", "topic-", "lang-", "theme-")
MOST = 0.6

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HEADING = re.compile(r"h[1-6]$")
_BLOCK_EDGE = re.compile(r"</?(?:p|div|section|article|main|body|html|h[1-6]|ul|ol|li|table|tr|td|footer|header|nav|aside|form|blockquote|pre)\b", re.I)
FEATURES = ["words", "link_density", "words_before", "links_before", "words_after", "links_after", "in_main",
            "in_aside", "heading", "paragraph", "item", "sentence", "page_has_main"]


def attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag by name; the first of a name holds."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def named_words(value: str) -> set[str]:
    """The words of a class, id or role that can name matter."""
    words: set[str] = set()
    for name in value.split():
        if name.lower().replace("_", "-").startswith(TOPICS):
            continue
        parts = [x.lower() for x in _NAME.findall(name) if not x.isdigit()]
        if len(parts) <= 3:
            words |= {x for x in parts if x not in LONE_WORDS or len(parts) == 1}
    return words


class _Element:
    __slots__ = ("tag", "parent", "main", "mark", "words", "mains")

    def __init__(self, tag: str, parent: int, main: bool, mark: str):
        self.tag, self.parent, self.main, self.mark = tag, parent, main, mark
        self.words = self.mains = 0


def _marks(tag: str, raw: str) -> tuple[bool, str]:
    """(whether the element is for main text, the kind of mark as other matter:
    hidden, comment, firm, layout, top or none)."""
    main = tag in MAIN
    mark = "layout" if tag in ASIDE else "top" if tag == "header" else ""
    if raw and tag not in ("html", "body"):
        a = attributes(raw)
        words = named_words(" ".join(a.get(k, "") for k in ("class", "id", "role")))
        if tag in MAIN:
            mark = "comment" if words & COMMENT_WORDS else ""
        elif words & COMMENT_WORDS:
            mark = "comment"
        elif words & FIRM_WORDS:
            mark = "firm"
        elif words & TOP_WORDS:
            mark = mark or "top"
        elif words & (LAYOUT_WORDS | LONE_WORDS):
            mark = "layout"
        main = main or bool(words & MAIN_WORDS)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
            mark = "hidden"
    return main and not mark, mark


class _Page:
    """Collects the elements of one page and its blocks: (text, words in
    links, element, kind)."""

    def __init__(self):
        self.elements = [_Element("", -1, False, "")]
        self.open: list[int] = []
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.kind = ""
        self.blocks: list[tuple[str, int, int, str]] = []

    def text(self, raw: str) -> None:
        if raw:
            s = unescape(raw) if "&" in raw else raw
            self.parts.append(s)
            if self.links:
                self.linked += len(s.split())

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append((" ".join(words), self.linked, self.open[-1] if self.open else 0, self.kind))
            self.parts, self.linked = [], 0

    def begin(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            self.kind = tag
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or _HEADING.match(tag):
                self.close_like(tag)
        if tag in VOID or attrs.endswith("/") and tag not in ("a", "p", "div"):
            return
        if tag == "a":
            self.links += 1
        self.elements.append(_Element(tag, self.open[-1] if self.open else 0, *_marks(tag, attrs)))
        self.open.append(len(self.elements) - 1)

    def tag_at(self, i: int) -> str:
        return self.elements[self.open[i]].tag

    def close_like(self, tag: str) -> None:
        """A new paragraph, item or cell ends the open one of its kind."""
        for i in range(len(self.open) - 1, -1, -1):
            t = self.tag_at(i)
            if t == tag or t == "p":
                self.pop_to(i)
                return
            if t not in INLINE:
                return

    def pop_to(self, i: int) -> None:
        self.links -= sum(self.elements[e].tag == "a" for e in self.open[i:])
        del self.open[i:]

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            t = self.tag_at(i)
            if t == tag:
                self.pop_to(i)
                break
            if tag in INLINE and t not in INLINE:
                break  # an inline end tag does not close blocks
        if tag not in INLINE:
            self.kind = self.tag_at(-1) if self.open else ""

    def judged(self) -> list[tuple[str, int, bool, bool, str]]:
        """The blocks with whether they lie in main text and in other
        matter."""
        els = self.elements
        for text, _, e, _ in self.blocks:
            els[e].words += text.count(" ") + 1
        for e in reversed(els):  # children come after their parents
            if e.parent >= 0:
                els[e.parent].words += e.words
                els[e.parent].mains += e.mains + (e.tag in MAIN and e.mark == "")
        in_main, in_aside = [False] * len(els), [False] * len(els)
        total, mains = els[0].words, els[0].mains
        for i, e in enumerate(els):
            up = e.parent if i else 0
            in_main[i] = in_main[up] or e.main
            most = e.words > MOST * total and not in_main[up] and e.tag not in FIRM_TAGS
            if e.mark == "hidden":
                other = True
            elif e.mark in ("comment", "firm"):
                other = not (most and mains and e.mains == mains)
            elif e.mark == "layout":
                other = not (e.mains or most)
            else:
                other = e.mark == "top" and not (in_main[up] or e.mains or most)
            in_aside[i] = in_aside[up] or other
        return [(text, linked, in_main[e], in_aside[e], kind) for text, linked, e, kind in self.blocks]


def _raw_end(tag: str, html: str, at: int) -> int:
    """Where the matter of an element without text ends."""
    m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
    if tag in OPEN_ENDED:
        return m.end() if m else len(html)
    again = re.compile(rf"<{re.escape(tag)}\b", re.I).search(html, at, m.start() if m else len(html)) if tag in ("select", "textarea", "title") else None
    if m and not again:
        return m.end()
    edge = _BLOCK_EDGE.search(html, at)
    return edge.start() if edge else len(html)


def blocks_of(html: str) -> list[tuple[str, int, bool, bool, str]]:
    """The flat text blocks of a page in page order: (text, words in links,
    in main text, in other matter, kind)."""
    page, at, n = _Page(), 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            page.text(html[at:])
            break
        page.text(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            page.end(tag)
        elif tag in RAW:
            if not (m[3] or "").endswith("/") or tag in ("script", "style", "title", "textarea"):
                at = _raw_end(tag, html, at)
        else:
            page.begin(tag, m[3] or m[6] or "")
    page.flush()
    return page.judged()


def block_features(blocks) -> np.ndarray:
    """One row of FEATURES a block."""
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    words = np.array([b[0].count(" ") + 1 for b in blocks], float)
    links = np.array([min(1.0, b[1] / w) for b, w in zip(blocks, words)])
    x[:, 0], x[:, 1] = words, links
    x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
    x[:, 6] = [b[2] for b in blocks]
    x[:, 7] = [b[3] for b in blocks]
    x[:, 8] = [bool(_HEADING.match(b[4])) for b in blocks]
    x[:, 9] = [b[4] in ("p", "blockquote", "pre", "b") for b in blocks]
    x[:, 10] = [b[4] in ("li", "td", "dt", "dd") for b in blocks]
    x[:, 11] = [b[0][-1] in ".!?…:;\"'”)" for b in blocks]
    x[:, 12] = x[:, 6].any()
    return x


class DecisionTree:
    """A binary classification tree grown by Gini impurity (numpy)."""

    def __init__(self, depth: int = 8, least: int = 3):
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "DecisionTree":
        self._grow(x, y.astype(float), self.depth)
        return self

    def _grow(self, x, y, depth) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, 0.0)
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, s = x[order, f], y[order]
                left = np.cumsum(s)[:-1]
                k = np.arange(1, len(y))
                right = s.sum() - left
                cost = left * (1 - left / k) + right * (1 - right / (len(y) - k))
                ok = (v[1:] > v[:-1]) & (k >= self.least) & (len(y) - k >= self.least)
                if ok.any():
                    i = np.flatnonzero(ok)[np.argmin(cost[ok])]
                    if cost[i] < best[0] - 1e-9:
                        best = (cost[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] is not None:
            side = x[:, best[1]] <= best[2]
            a = self._grow(x[side], y[side], depth - 1)
            b = self._grow(x[~side], y[~side], depth - 1)
            self.nodes[me] = (best[1], best[2], a, b, float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main-text blocks in each row's leaf."""
        at = np.zeros(len(x), int)
        feature, limit, left, right, share = (np.array(c) for c in zip(*self.nodes))
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            at = np.where(go, np.where(x[rows, f] <= limit[at], left[at], right[at]), at)
        return share[at]


@lru_cache(1)
def trained_tree() -> DecisionTree:
    """The tree of the labelled table; the same on every executor."""
    x, y = [], []
    for page in labelled_pages():
        blocks = blocks_of(page)
        x.append(block_features(blocks))
        y += [b[0].lstrip("#*- ")[:1].lower() == "k" for b in blocks]
    return DecisionTree().fit(np.concatenate(x), np.array(y))


def main_text(html: str | None, tree: DecisionTree | None = None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    keep = (tree or trained_tree()).predict(block_features(blocks)) > 0.5
    return "\n".join(b[0] for b, k in zip(blocks, keep) if k)


def _extract(tree):
    def run(batches):
        for b in pieces(batches, 2):
            text = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html"))
    return p.mapInArrow(_extract(trained_tree()), "page_id long, url string, text string, n_chars long")


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
