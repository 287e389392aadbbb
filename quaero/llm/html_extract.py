"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with its root-to-block tag path.  Per
path the text length, punctuation and link text of its blocks are summed.  A
path's ratio is text per block times punctuation per block, less for link text,
times a weight that says how its elements are used: paragraphs and headings
hold text, bare containers less, and elements that call themselves navigation,
adverts or comments little.  A block's score is the geometric mean of its path's
ratio and of that ratio smoothed along the blocks of its parent element; a
heading has at least the score of what it stands above.

Blocks above a share of the page's mean score are core content.  The main
element is the one with the most core text less other text.  Of the blocks in it
those are left out whose path is mostly links or weighs little, so short
paragraphs are not lost.  Only what is not text at all
(scripts, styles, hidden elements and the like) is passed over by name.

Reading takes time in proportion to the page: an element knows its parent and
its path's number, so neither depth nor broken markup is scanned again.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is core content from this share of the text-weighted mean score on; a path belongs to the main element from this weight on.
THRESHOLD, LEAST_WEIGHT = 0.15, 0.1
#: Weights of elements that are used for one purpose, and of a block whose own element is a bare container.
MAIN, ASIDE, BARE = 4.0, 0.02, 0.02

_QUOTED = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?=/?[a-zA-Z])|<[!?/][^>]*(?:>|\Z)""", re.S)
_SIMPLE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = frozenset("script style textarea title noscript template iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What has no text of the page's own.
_NO_TEXT = frozenset("head script style noscript template iframe button select option optgroup datalist textarea title svg canvas object audio video map math dialog".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre summary".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block, so none of them is a page's main element.
_ONE = _HEADING | frozenset("p pre caption figcaption summary dt".split())
_MAIN = frozenset(("article", "main"))
_ASIDE = frozenset("nav footer aside form menu".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Class and id names of containers that hold none of the main text, alone or with an ending that says what kind of box it is.
_ASIDE_NAME = re.compile(
    r"(?:ads?|adverts?|advertisements?|advertising|alerts?|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|login|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promos?|promoted|recommended|related|replies|shar(?:e|ing)|sidebar|signup|social|sponsor(?:s|ed)?|subscribe|toolbar)"
    r"(?:[-_]?(?:area|bar|block|box|container|form|holder|inner|links?|list|notice|nav|panel|popup|posts?|region|section|slot|thread|unit|widget|wrap(?:per)?|\d+))*",
    re.I,
)
_PUNCTUATION = re.compile(r"[,.;:!?…、。，！？；：]")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Page:
    """Blocks of text in page order, and the elements around them in the order of their start tags."""

    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    element: list[int] = field(default_factory=list)  # the innermost element of each block
    path: list[int] = field(default_factory=list)  # each block's path
    parent: list[int] = field(default_factory=lambda: [-1])  # each element's parent; element 0 is the page
    tag: list[str] = field(default_factory=lambda: [""])  # by element
    weight: list[float] = field(default_factory=lambda: [BARE])  # by path


def _use(tag: str, attributes: str) -> float:
    """How an element is used by what it calls itself: 0 not for text, else a weight of its path."""
    if tag in _NO_TEXT:
        return 0.0
    weight = MAIN if tag in _MAIN else ASIDE if tag in _ASIDE else 1.0
    if not attributes or attributes.isspace():
        return weight
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 0.0
        if tag in _TEXT or tag in ("html", "body", "main"):
            continue  # a paragraph's class says how it looks, a page's what it has
        if name == "role" and value in _ASIDE_ROLES or name in ("class", "id") and any(_ASIDE_NAME.fullmatch(x) for x in value.split()):
            weight = min(weight, ASIDE)
    return weight


def read(page: str) -> Page:
    """The text blocks of a page; white space is one space.  Blocks end where any element does that is not of one line of text."""
    out = Page()
    paths: dict[tuple[int, str, float], int] = {}
    # open elements that are not inline: tag, element, path, weight of the way to it, whether it is passed over
    stack: list[tuple[str, int, int, float, bool]] = [("", 0, 0, 1.0, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, link_from = 0, -1  # the depth at which a link began

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.text.append(text)
                out.linked.append(linked)
                out.element.append(stack[-1][1])
                out.path.append(stack[-1][2])
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw and not stack[-1][4]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_from >= 0:
                linked += len(text.strip())

    def pop():
        nonlocal link_from
        opened[stack.pop()[0]] -= 1
        if link_from >= len(stack):
            link_from = -1

    at, pattern = 0, _QUOTED
    while match := pattern.search(page, at):
        if match.end() == match.start() + 1:  # an attribute is never closed: from here on tags end at the next bracket
            pattern = _SIMPLE
            continue
        say(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), match[1], match[3]
        if tag == "a":
            link_from = -1 if closing else len(stack) - 1
        if tag in _INLINE:
            continue
        if closing:
            if opened[tag] > 0:
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if stack[-1][0] == "p" or stack[-1][0] in _CLOSES.get(tag, ()):
            pop()
            if tag == "tr" and stack[-1][0] == "tr":
                pop()
        _, above, path, way, passed = stack[-1]
        use = _use(tag, attributes)
        way = min(MAIN, max(way * (use or 1.0), ASIDE * ASIDE))
        number = paths.setdefault((path, tag, use), len(out.weight))
        if number == len(out.weight):
            out.weight.append(way * (1.0 if tag in _TEXT else BARE))
        out.parent.append(above)
        out.tag.append(tag)
        stack.append((tag, len(out.parent) - 1, number, way, passed or not use))
        opened[tag] += 1
        if tag in _RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{tag}(?![\w-])", re.I).search(page, at)
            at = end.start() if end else len(page)
    say(page[at:])
    flush()
    return out


def scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused score, and its path's weight less its share of link text."""
    path = np.array(page.path)
    size = np.array([len(t) for t in page.text], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.text], float)
    linked = np.minimum(size, np.array(page.linked, float))
    n, text, punctuation, links = (np.bincount(path, x) for x in (np.ones(len(path)), size, marks, linked))
    some = np.maximum(n, 1)
    own = (1 - links / np.maximum(text, 1)) ** 2
    weight = own * np.array(page.weight)[: len(n)]
    raw = (text / some * (0.3 + punctuation / some) * weight)[path]
    parent = np.array(page.parent)[np.array(page.element)]
    before, after = np.zeros(len(raw)), np.zeros(len(raw))
    same = parent[1:] == parent[:-1]
    before[1:], after[:-1] = np.where(same, raw[:-1], raw[1:]), np.where(same, raw[1:], raw[:-1])
    if len(raw):
        before[0], after[-1] = raw[0], raw[-1]
    loose = np.array([page.tag[e] not in _ONE for e in page.element], bool)
    alone = np.where(loose, (1 - linked / np.maximum(size, 1)) ** 2, 1.0)  # a paragraph may be a link; in boxes of one path each answers for its own
    fused = alone * np.sqrt(raw * (0.25 * before + 0.5 * raw + 0.25 * after))
    heading = [page.tag[e] in _HEADING for e in page.element]
    for i in range(len(raw) - 2, -1, -1):  # a heading is worth what it stands above
        if heading[i] and same[i]:
            fused[i] = max(fused[i], fused[i + 1])
    return fused, alone * weight[path]


def extract(page: str | None) -> str:
    """The main text of a page: its content blocks in page order, joined by an empty line."""
    found = read(page or "")
    if not found.text:
        return ""
    score, weight = scores(found)
    size = np.array([len(t) for t in found.text], float)
    total = (size * score).sum()
    mean = (size * score * score).sum() / total if total > 0 else 0.0  # each character weighs as its score, so much text around a short article does not hide it
    core = score >= THRESHOLD * mean
    held = weight >= LEAST_WEIGHT * weight.max()
    gain = np.bincount(found.element, np.where(core, size, np.where(held, -size, -size / 8)), len(found.parent))  # what is not held is left out anyhow
    last = list(range(len(found.parent)))  # the last element inside each
    for e in range(len(found.parent) - 1, 0, -1):
        p = found.parent[e]
        gain[p] += gain[e]
        last[p] = max(last[p], last[e])
    gain[[t in _ONE for t in found.tag]] = -np.inf
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))  # of equal ones the innermost
    inside = (np.array(found.element) >= best) & (np.array(found.element) <= last[best])
    content = inside & (core | (weight >= LEAST_WEIGHT * np.max(weight[inside], initial=0.0)))
    return "\n\n".join(t for t, c in zip(found.text, content, strict=True) if c)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null and empty pages, and pages without content, have an empty text.  Whole
    pages are read.  Rows repeated or with a null page_id or url each give a
    row; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            text = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
