"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block gets its word count
and link density, those of the blocks before and after it, and where it
stands: inside an article or main element, inside a menu, header, footer,
sidebar, form or the like, inside an element whose class or id says so, in a
heading, and whether the page has an article at all. A small decision tree,
fitted on a labelled table of such blocks, decides which blocks are content.

Scripts, styles, comments and other content that isn't shown are left out
before. Character references are decoded once, white space inside a block
becomes one space, and blocks are joined in page order by an empty line.
Unclosed and misnested tags are accepted: a closing tag ends the innermost
open element of its name, or nothing. A line break tag counts as white space.

Scale: pages are independent rows; nothing is shuffled; the tree has a fixed
size. Null and empty pages, and pages without content, give the empty text.
Repeated rows give equal rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_frame", "named", "heading", "page_main")

#: The labelled table. Columns as in FEATURES, then content or not.
LABELLED = (
    # blocks of an article element
    (60, 0.0, 55, 0.0, 80, 0.0, 1, 0, 0, 0, 1, 1), (1, 0.0, 40, 0.0, 35, 0.0, 1, 0, 0, 0, 1, 1), (8, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 1, 1, 1),
    (25, 0.2, 30, 0.0, 3, 1.0, 1, 0, 0, 0, 1, 1), (3, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 0, 1, 1), (12, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 1),
    (4, 0.0, 4, 0.0, 30, 0.0, 1, 0, 0, 1, 1, 1), (2, 1.0, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 1, 1), (300, 0.05, 4, 0.0, 9, 0.0, 1, 0, 0, 0, 1, 1),
    (9, 0.0, 1, 1.0, 40, 0.0, 1, 0, 0, 1, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 1), (40, 0.5, 20, 0.0, 20, 0.0, 1, 0, 0, 0, 1, 1),
    (5, 0.0, 12, 0.0, 1, 0.0, 1, 0, 0, 0, 1, 1), (2, 0.0, 1, 0.0, 2, 0.0, 1, 0, 0, 0, 1, 1), (3, 0.0, 2, 0.0, 9, 0.0, 1, 0, 0, 0, 1, 1), (4, 0.0, 1, 0.0, 3, 0.0, 1, 0, 0, 0, 1, 1),
    (10, 0.8, 2, 0.0, 4, 0.0, 1, 0, 0, 0, 1, 1), (6, 1.0, 3, 0.5, 3, 0.0, 1, 0, 0, 0, 1, 1), (20, 0.6, 1, 0.0, 12, 0.0, 1, 0, 0, 0, 1, 1), (1, 1.0, 4, 0.0, 2, 1.0, 1, 0, 0, 0, 1, 1),
    (7, 0.0, 5, 1.0, 5, 0.0, 1, 0, 0, 1, 1, 1), (15, 0.0, 1, 0.0, 0, 0.0, 1, 0, 0, 0, 1, 1), (3, 1.0, 0, 0.0, 1, 0.0, 1, 0, 0, 1, 1, 1), (30, 0.4, 4, 0.0, 6, 0.0, 1, 0, 0, 0, 1, 1),
    # inside an article, but menus, forms, adverts, comments
    (4, 0.0, 60, 0.0, 70, 0.0, 1, 0, 1, 0, 1, 0), (30, 0.0, 45, 0.0, 50, 0.0, 1, 0, 1, 0, 1, 0), (3, 1.0, 25, 0.0, 3, 1.0, 1, 1, 0, 0, 1, 0),
    (12, 0.1, 80, 0.0, 5, 0.0, 1, 1, 0, 0, 1, 0), (50, 0.0, 70, 0.0, 45, 0.0, 1, 0, 1, 0, 1, 0), (6, 0.0, 30, 0.0, 2, 0.0, 1, 1, 0, 1, 1, 0),
    (2, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1, 1, 1, 0), (90, 0.0, 20, 0.0, 30, 0.0, 1, 1, 1, 0, 1, 0), (1, 1.0, 60, 0.0, 0, 0.0, 1, 1, 1, 0, 1, 0),
    # outside the article of a page that has one
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 1, 0), (7, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 0, 1, 0), (9, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 1, 0),
    (40, 0.0, 3, 0.0, 40, 0.0, 0, 0, 0, 0, 1, 0), (80, 0.0, 60, 0.0, 10, 0.0, 0, 1, 0, 0, 1, 0), (5, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0, 1, 1, 0),
    (20, 0.6, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 1, 0), (60, 0.0, 9, 0.0, 50, 0.0, 0, 0, 1, 0, 1, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, 0, 0, 0, 1, 0),
    (30, 0.0, 20, 0.0, 40, 0.0, 0, 0, 0, 0, 1, 0), (100, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 1, 0), (25, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1, 0), (9, 0.0, 50, 0.0, 5, 0.0, 0, 0, 0, 1, 1, 0),
    # pages without such an element
    (50, 0.0, 45, 0.0, 60, 0.0, 0, 0, 0, 0, 0, 1), (30, 0.1, 8, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (18, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 50, 0.0, 0, 0, 0, 1, 0, 1), (5, 0.0, 40, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1), (14, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1),
    (200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (11, 0.0, 16, 0.0, 12, 0.0, 0, 0, 0, 0, 0, 1), (4, 0.0, 30, 0.0, 22, 0.0, 0, 0, 0, 1, 0, 1),
    (15, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (16, 0.0, 1, 0.0, 17, 0.0, 0, 0, 0, 0, 0, 1), (13, 0.0, 1, 1.0, 16, 0.0, 0, 0, 0, 0, 0, 1),
    (19, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 0, 1), (12, 0.0, 11, 0.0, 4, 1.0, 0, 0, 0, 0, 0, 1), (24, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 1), (17, 0.1, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0), (20, 0.8, 4, 1.0, 50, 0.0, 0, 0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0), (35, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1, 0, 0, 0), (60, 0.0, 50, 0.0, 3, 1.0, 0, 1, 0, 0, 0, 0),
    (3, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 0, 0), (8, 0.0, 30, 0.0, 5, 0.0, 0, 0, 1, 0, 0, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0),
    (12, 0.5, 40, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 2, 0.0, 0, 1, 0, 0, 0, 0), (4, 0.0, 8, 0.0, 6, 1.0, 0, 1, 0, 1, 0, 0),
)

#: Tag names.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
FRAME_TAGS = frozenset("nav footer aside form menu dialog fieldset button select label input".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|textarea|title|iframe"
HIDDEN_TAGS = "noscript|template|svg|math|object|canvas|select|audio|video"
#: Closed by a slash: foreign elements, and in pages written as XHTML the empty embedded ones.
SELF_CLOSED = "svg|math|iframe|object"
NESTED_TAGS = frozenset(["svg", "object", "template"])
#: Words that name what isn't content. A class, role or id does where it is made of these and of PLAIN words only.
NAMES = frozenset(
    "ad ads adv advert adverts advertising advertisement advertisements sponsor sponsors sponsored promo promos promotion promotions banner banners cookie cookies consent notice notices alert alerts"
    " sidebar sidebars menu menus nav navs navbar navigation breadcrumb breadcrumbs footer masthead topbar contentinfo complementary"
    " comment comments commentlist reply replies respond disqus share shares sharing sharebar social related recommend recommended recommendation recommendations newsletter newsletters subscribe subscription"
    " signup login popup modal overlay widget widgets toolbar pagination pager legal copyright disclaimer".split()
)
PLAIN = frozenset(
    "area articles bar block body bottom box btn button buttons card cards center column container content count cta dialog footer form foot global group head header holder icon icons inline inner item items"
    " js left link links list main media message meta middle mobile module outer page pages panel policy popular post posts primary right row secondary section site slot small stories text thread title to top unit video videos wp wrap wrapper".split()
)
_ARTICLE_NAMES = frozenset("comment comments reply replies advert adverts advertisement sponsor sponsored".split())
_MAIN_NAMES = re.compile(r"(?:^|[^a-z])(?:article-?body|post-?(?:body|content)|entry-?content|main-?content|article-?content)(?:$|[^a-z])")

#: A tag's attributes, up to the closing bracket.
_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
# an element that isn't shown goes up to its end tag; one that closes itself, or whose end tag is missing, is its tag alone (raw text goes on to the end)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<alone>" + SELF_CLOSED + r")(?=[\s/>])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    r"|<(?P<raw>" + RAW_TAGS + r")(?=[\s/>])" + _REST + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<hidden>" + HIDDEN_TAGS + r")(?=[\s/>])" + _REST + r">"
    r"|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s>/]*+)(?P<rest>" + _REST + r"|[^>]*+)(?:>|\Z)",
    re.S | re.I,
)
_SAME = {t: re.compile(rf"<(?P<close>/?){t}(?=[\s/>]){_REST}>", re.I | re.S) for t in HIDDEN_TAGS.split("|")}


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each start tag of the name ends: where its end tag ends; without the unclosed ones."""
    out, opened = {}, []
    for m in _SAME[tag].finditer(page):
        if not m["close"]:
            if not m[0].endswith("/>"):
                opened.append(m.end())
        elif tag in NESTED_TAGS:
            if opened:
                out[opened.pop()] = m.end()
        else:
            out.update(dict.fromkeys(opened, m.end()))
            opened.clear()
    return out


def _tokens(page: str) -> Iterator[tuple[int, int, re.Match]]:
    """(start, end, match) of each tag or hidden part, in order."""
    at, ends = 0, {}
    while m := _TOKEN.search(page, at):
        at = m.end()
        if tag := (m["hidden"] or "").lower():
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            at = ends[tag].get(at, at)
        yield m.start(), at, m


_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names(tag: str, given: list[tuple[str, str]], main: int, words: frozenset = NAMES) -> bool:
    """Whether the element's class, role or id names what isn't content. Ids of
    headings, and of other than plain containers inside an article, are slugs of its text."""
    ids = tag not in _HEADINGS and (not main or tag in ("div", "ul", "ol"))
    for name, value in given:
        if ids or name.lower() != "id":
            for token in value.strip("\"'").lower().split():
                parts = [x for x in re.split("[^a-z]+", token) if x]
                if not words.isdisjoint(parts) and all(x in NAMES or x in PLAIN for x in parts):
                    return True
    return False


class Blocks:
    """The flat blocks of one page: texts and the raw features of each."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.rows: list[tuple] = []  # (words, linked words, in_main, in_frame, named, heading)

    def add(self, parts: list[str], linked: int, where: tuple, heading: int) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            self.texts.append(text)
            self.rows.append((words, min(linked, words), *where, heading))


def cut(page: str) -> Blocks:
    """The blocks of a page in order."""
    out, parts, linked, link, at = Blocks(), [], 0, False, 0
    stack: list[tuple[str, tuple]] = []
    where, heading = (0, 0, 0), 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if link:
                linked += len(html.unescape(piece).split())

    def flush() -> None:
        nonlocal linked
        if parts:
            out.add(parts, linked, where, heading)
            parts.clear()
        linked = 0

    for start, end, m in _tokens(page):
        text(page[at:start])
        at = end
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["close"]
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS and tag != "hr" or tag not in BLOCK_TAGS and tag not in FRAME_TAGS and tag != "span":
            continue
        block = tag in BLOCK_TAGS or tag in FRAME_TAGS
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if block:
                flush()
                link = False
            if depth is not None:
                del stack[depth:]
        else:
            given = _NAMED.findall(m["rest"]) if "=" in m["rest"] else []
            names = " ".join(x.strip("\"'") for _, x in given).lower()
            if not block and not (given and _names(tag, given, stack[-1][1][0] if stack else 0)):
                stack.append((tag, where))
                continue
            flush()
            if block:
                link = False
                if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):  # an open sibling ends
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "div", "article"):
                            break
                elif stack and any(t == "p" for t, _ in stack[-3:]) and tag in BLOCK_TAGS:  # a paragraph ends where a block begins
                    i = max(j for j, (t, _) in enumerate(stack) if t == "p")
                    del stack[i:]
            main, frame, named = stack[-1][1] if stack else (0, 0, 0)
            main = int(main or tag in ("article", "main") or "main" in names.split() or bool(names and _MAIN_NAMES.search(names)))
            frame = int(frame or tag in FRAME_TAGS or (tag == "header" and not main))
            if tag not in ("html", "body", "article", "main"):
                named = int(named or bool(given and _names(tag, given, main)))
            elif tag == "article" and main and given and _names(tag, given, main, _ARTICLE_NAMES):
                named = 1
            if tag != "hr":
                stack.append((tag, (main, frame, named)))
        where = stack[-1][1] if stack else (0, 0, 0)
        heading = int(any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, _ in stack[-2:]))
    text(page[at:])
    flush()
    return out


def features(pages: list[Blocks]) -> np.ndarray:
    """One row of FEATURES per block of all pages."""
    rows = np.array([r for p in pages for r in p.rows], float).reshape(-1, 6)
    sizes = np.array([len(p.rows) for p in pages], int)
    first = np.zeros(len(rows), bool)
    last = np.zeros(len(rows), bool)
    ends = np.cumsum(sizes)
    first[(ends - sizes)[sizes > 0]] = True
    last[ends[sizes > 0] - 1] = True
    words, links = rows[:, 0], rows[:, 1] / np.maximum(rows[:, 0], 1)
    shift = lambda x, by, edge: np.where(edge, 0.0, np.roll(x, by)) if len(x) else x
    has = np.repeat(np.array([any(r[2] and not r[3] and not r[4] for r in p.rows) for p in pages], float), sizes)
    return np.column_stack([words, links, shift(words, 1, first), shift(links, 1, first), shift(words, -1, last), shift(links, -1, last), rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5], has])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A decision tree by Gini impurity: (feature, limit, low side, high side) or a class."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return (int(y.sum() * 2 >= len(y)),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            impurity = sum(s.sum() * (m := y[s].mean()) * (1 - m) for s in (low, ~low))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit))
    if best[0] == np.inf:
        return (int(y.sum() * 2 >= len(y)),)
    low = x[:, best[1]] < best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    """The tree fitted on the labelled table."""
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(node: tuple, x: np.ndarray) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), bool(node[0]))
    low = x[:, node[0]] < node[1]
    out = np.zeros(len(x), bool)
    out[low], out[~low] = classify(node[2], x[low]), classify(node[3], x[~low])
    return out


def main_texts(pages: list[str | None], node: tuple) -> list[str]:
    """The main text of each page."""
    cuts = [cut(p or "") for p in pages]
    keep = classify(node, features(cuts))
    out, at = [], 0
    for p in cuts:
        out.append("\n\n".join(t for t, k in zip(p.texts, keep[at : at + len(p.texts)]) if k))
        at += len(p.texts)
    return out


def extract(pages: DataFrame, *, page_id="page_id", url="url", page="html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    fields = [pages.schema[page_id], pages.schema[url]]
    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts(part.column(2).to_pylist(), node)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {fields[0].dataType.simpleString()}, url {fields[1].dataType.simpleString()}, text string, n_chars bigint"
    return pages.select(F.col(page_id), F.col(url), F.col(page).cast("string")).mapInArrow(run, schema)
