"""Main text of web pages by their line-block distribution.

Markup is stripped so that each block element is one line; a container of blocks leaves an empty line where it begins and
where it ends, so does an element that hints at other text than what it stands in, and ``<article>`` and ``<main>`` leave two. A line's mass is its length without its links' text, times what its markup
hints at. The distribution is the sum of masses over a window of lines around each line. Where it surges over a threshold a
region of text begins, where it dives under a lower one the region ends, and all lines between are kept, short ones, too. Both
thresholds come from the page's own distribution.

Hints are weights, not verdicts: a page that stands in a form or in a wrapper of class "with-sidebar" as a whole loses nothing,
since weights only count against the page's mean. Nothing but markup, elements that by HTML's own definition hold no part of
the article (``<nav>``, ``<footer>``, ``<menu>``, ``<dialog>``, ``<button>``) and hidden ones is dropped without a look at the distribution.

Defined cases: null or empty html gives the empty text; unclosed and truncated markup is read as far as it goes; very long pages are
read whole, in time proportional to their length; equal sums fall to the same side of a threshold; a page without a surge gives the
empty text; repeated rows give a row each; an empty table gives an empty result; columns besides ``page_id``, ``url`` and ``html``,
whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lagweave.session import map_arrow

#: Lines in a window.
WINDOW = 3
#: A region surges over so many characters of plain text or over this share of the page's mean window, whichever is less.
SURGE, SHARE = 40.0, 0.2
#: It dives under this part of the surge.
DIVE = 0.125
#: What hints are worth: an article element, a heading, an ambiguous word in an article, a form, a telling word.
ARTICLE, HEADING, AMBIGUOUS, FORM, TELLING = 100.0, 3.0, 0.5, 0.3, 0.002

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_closing: dict[str, re.Pattern] = {}


def _close_of(name: str) -> re.Pattern:
    if name not in _closing:
        _closing[name] = re.compile(rf"</{name}\s*>", re.I)
    return _closing[name]


# HTML's elements, by what they do to text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Elements that cut a page into parts, so that one without blocks inside is a part, too, if parts stand beside it.
PARTS = {"article", "aside", "center", "dialog", "div", "fieldset", "footer", "form", "header", "main", "menu", "nav", "section", "table"}
#: Elements that leave empty lines if they hold blocks.
CONTAINERS = PARTS | {"blockquote", "details", "dl", "figure", "ol", "ul"}
NEVER = {"button", "dialog", "footer", "head", "menu", "nav"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of class, id and role that hint at what is not the article; ambiguous ones hint at little inside one.
TELLING_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "popup", "promo", "related", "replies", "sidebar", "skip", "sponsor", "sponsored", "toolbar"}
AMBIGUOUS_WORDS = {"banner", "footer", "header", "notice", "reply", "share", "sharing", "signup", "social", "subscribe", "widget"}
#: Words that make an ambiguous one mean a part of the article ("post-header").
ARTICLE_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text"}


@dataclass
class Line:
    """``plain``: characters outside links; ``weight``: what the hints make of them. Empty lines stand around containers."""

    text: str
    plain: int
    weight: float


@dataclass(eq=False)
class _Element:
    """An open element; ``gap``: empty lines where it begins and where it ends."""

    name: str
    weight: float
    article: bool
    never: bool
    gap: int = 0
    blocks: list[_Element] = field(default_factory=list)


_EMPTY = Line("", 0, 0.0)


def _hints(attributes: str) -> tuple[set[str], bool, bool]:
    """The words of class, id and role, whether the role is that of the main text, and whether the element is hidden."""
    words: set[str] = set()
    main = hidden = False
    for kind, value in _ATTRIBUTES.findall(attributes):
        kind, value = kind.lower(), value.strip("\"'")
        if kind in ("class", "id", "role"):
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
            main |= kind == "role" and value.lower() in ("main", "article")
        elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, main, hidden


def _open(name: str, attributes: str, above: _Element) -> _Element:
    words, main, hidden = _hints(attributes) if attributes else (set(), False, False)
    article, weight = above.article, above.weight
    if name in ("article", "main") or main:
        weight, article = weight if article else weight * ARTICLE, True
    elif name == "form":
        weight *= FORM
    elif name == "aside" or name == "header" and not article:
        weight = min(weight, TELLING)
    elif name in HEADINGS:
        weight *= HEADING
    if name not in ("html", "body"):
        if words & TELLING_WORDS:
            weight = min(weight, TELLING)
        elif words & AMBIGUOUS_WORDS and not words & ARTICLE_WORDS:
            weight = weight * AMBIGUOUS if article else min(weight, TELLING)
    out = _Element(name, weight, article, above.never or hidden or name in NEVER)
    if out.article != above.article or out.never != above.never:
        out.gap = 2
    elif weight < above.weight:
        out.gap = 1
    return out


def _settle(parents: list[_Element]) -> None:
    """Containers of blocks leave empty lines, and so does a part without blocks among parts that do."""
    for e in parents:
        if e.blocks and e.name in CONTAINERS:
            e.gap = max(e.gap, 1)
    for e in parents:
        parts = [b for b in e.blocks if b.name in PARTS]
        if any(b.gap for b in parts):
            for b in parts:
                b.gap = max(b.gap, 1)


def lines(page: str) -> list[Line]:
    """The page's lines in order, with the empty lines around containers."""
    events: list[Line | _Element] = []  # an element stands where it begins and where it ends
    elements = [_Element("", 1.0, False, False)]
    stack = [elements[0]]
    text: list[str] = []
    linked = links = 0
    at, n = 0, len(page)

    def end_line() -> None:
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line and not stack[-1].never:
            events.append(Line(line, max(len(line) - linked, 0), stack[-1].weight))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(entities.unescape(piece).strip()) + 1

    def close(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            closed = stack.pop()
            links -= closed.name == "a"
            if closed.name in BLOCK:
                events.append(closed)

    while at < n:
        tag = _TOKEN.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[3] or "").lower()
        if tag[1] is not None:
            add(tag[1])
        if not name:
            continue
        if name in BLOCK:
            end_line()
        if tag[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
        elif name in RAW:
            end = _close_of(name).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not tag[4].endswith("/"):
            if name == "p" and stack[-1].name == "p":
                close(len(stack) - 1)
            new = _open(name, tag[4], stack[-1])
            links += name == "a"
            if name in BLOCK:
                for above in reversed(stack):
                    if above.name in BLOCK or above is stack[0]:
                        above.blocks.append(new)
                        break
                elements.append(new)
                events.append(new)
            stack.append(new)
    end_line()
    _settle(elements)
    out: list[Line] = []
    for e in events:
        if isinstance(e, Line):
            out.append(e)
        else:
            out += [_EMPTY] * e.gap
    return out


def masses(found: list[Line]) -> list[float]:
    """Lengths outside links times weights. Where the page's mean weight is below that of plain text it is what weights count against."""
    plain = sum(x.plain for x in found)
    mean = sum(x.plain * x.weight for x in found) / max(plain, 1)
    scale = 1 / min(mean, 1.0) if mean > 0 else 1.0
    return [x.plain * x.weight * scale for x in found]


def window_sums(mass: list[float], window: int = WINDOW) -> list[float]:
    """For each line the sum over the ``window`` lines around it."""
    before, after = (window - 1) // 2, window // 2 + 1
    total = [0.0, *accumulate(mass)]
    return [total[min(i + after, len(mass))] - total[max(i - before, 0)] for i in range(len(mass))]


def regions(found: list[Line], window: int = WINDOW) -> list[tuple[int, int]]:
    """First and last-but-one lines of the regions between surge and dive."""
    mass = masses(found)
    sums = window_sums(mass, window)
    if not any(mass):
        return []
    # the mean window as a character sees it, and the mean weight: a page of article elements asks for more of what stands outside
    mean = sum(s * s for s in sums) / sum(sums)
    weight = sum(mass) / max(sum(x.plain for x in found), 1)
    surge = min(SURGE * max(weight, 1.0) ** 0.5, SHARE * mean)
    out, begin, surged, empty = [], None, False, 0
    for i, (x, s) in enumerate(zip(found, sums, strict=True)):
        empty = empty + 1 if not x.text else 0
        if s <= DIVE * surge or empty >= max(window - 1, 1):
            if surged:
                out.append((begin, i))
            begin, surged = None, False
        else:
            begin = i if begin is None else begin
            surged |= s >= surge
    if surged:
        out.append((begin, len(found)))
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    found = lines(page or "")
    return "\n".join(x.text for a, b in regions(found, window) for x in found[a:b] if x.text)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return map_arrow(pages.select("page_id", "url", "html"), run, schema)
