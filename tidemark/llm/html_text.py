"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import arrow_map, col, text_or_empty

#: Lines in a window, and the characters that a window of running text has at least.
WINDOW, SURGE = 3, 86
#: Running text beside marked articles, more than they hold, from which on the marks are not the page's article.
PROSE = WINDOW * SURGE

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are not running text, whatever they hold.
_APART = frozenset(
    "aside button canvas dialog footer form head header iframe input menu nav noembed noframes noscript object "
    "option script search select style svg template textarea title audio video map math datalist".split()
)
#: Of these the ones that only interrupt a text.
_BRIEF = _APART - frozenset("aside footer form head header menu nav search".split())
_MAIN = frozenset(("article", "main"))
_CONTAINERS = frozenset(
    "article blockquote center dd details div dl fieldset figure li main ol section table tbody td tr ul".split()
)
_CLOSED_BY_ITS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th")} | {
    x: ("td", "th") for x in ("td", "th")
}
_SCOPES = frozenset("article aside body div footer header li main nav section table td th ul ol dl form".split())

#: Words of a class or id that name something beside the article, and of these the ones that only interrupt it.
_INTERRUPTS = frozenset(
    "ad ads adslot adsense advert adverts advertisement advertising banner billboard newsletter paywall popup promo "
    "promotion promoted recommendations recommended related share sharing shares signup skyscraper social sponsor "
    "sponsored subscribe subscription toolbar".split()
)
_BESIDE = _INTERRUPTS | frozenset(
    "alert breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion "
    "disqus dropdown foot footer form gdpr header login masthead menu menus modal nav navbar navigation notice notices "
    "notification overlay pager pagination replies reply respond responses search sidebar sidenav skip topbar widget "
    "widgets".split()
)
#: Words that may stand beside one of them in a name; any other word makes it a name of something else.
_PARTNERS = frozenset(
    "area article articles aside bar block body bottom box btn bubble button buttons card center column container "
    "content count desktop entry feed fixed floating global google group icon icons inline inner item items js left "
    "link links list main message mini mobile module msg news outer page panel policy post posts primary reader "
    "right row secondary section site slot small sticky story stories tab text thread title top unit user users view "
    "wrap wrapper zone".split()
)
#: What a header belongs to that is part of the article.
_OWN = frozenset("article content entry main post story".split())
_BESIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
_NEGATING = frozenset(("with", "has", "no", "without", "not"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _names_of(value: str) -> frozenset[str]:
    """The words of a class or id that name something beside the article.

    A name counts if all its words are such or their partners: "social-share" and
    "sidebar-left" do, "social-history" and "form-story" are other things.
    """
    found: set[str] = set()
    for name in value.split():
        parts = [p.lower() for p in _PART.findall(name) if not p.isdigit()]
        beside = _BESIDE.intersection(parts)
        other = [p for p in parts if p not in _BESIDE and p not in _PARTNERS]
        if not beside or other or _NEGATING.intersection(parts):
            continue
        if beside == {"form"} and parts[0] == "form" and len(parts) > 1:
            continue
        if beside == {"header"} and _OWN.intersection(parts):
            continue
        found |= beside
    return frozenset(found)


def _kind(tag: str, attributes: str, within: bool, names: bool) -> tuple[bool, bool, bool]:
    """Is the element beside the article, does it only interrupt it, and is it the article?

    ``within`` tells of an article that is open: its header is its own.
    """
    by_tag = tag in _APART and not (tag == "header" and within)
    brief = by_tag and tag in _BRIEF
    if not attributes.strip(" /\n\t"):
        return by_tag, brief, tag in _MAIN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    main = tag in _MAIN or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
    named = _names_of(found.get("class", "")) | _names_of(found.get("id", "")) if names else frozenset()
    if tag in ("html", "body") or main and not named:
        return by_tag, brief, main
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style
    apart = by_tag or role in _BESIDE_ROLES or hidden or bool(named)
    return apart, brief or hidden or bool(named) and named <= _INTERRUPTS, False


class Line(NamedTuple):
    """A stretch of text between block borders, or, with no text, something that is no running text."""

    text: str
    main: bool
    linked: bool = False  # mostly links
    heading: bool = False
    path: tuple[int, ...] = ()  # the open containers, numbered, from the outermost below the page's body
    brief: bool = False  # a gap that only interrupts


class _Lines:
    """Lines of a page's text: one for each stretch between block borders."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self._pieces: list[str] = []
        self._linked = 0

    def add(self, text: str, link: bool) -> None:
        self._pieces.append(text)
        if link:
            self._linked += len(text)

    def end(self, open_: "_Open") -> None:
        """A block border."""
        if not self._pieces:
            return
        text = " ".join(unescape("".join(self._pieces)).split())
        if text:
            links = self._linked * 2 > sum(map(len, self._pieces))
            heading = any(e.tag in _HEADINGS for e in open_.stack[-3:])
            self.rows.append(Line(text, open_.main > 0, links, heading, open_.path()))
        self._pieces, self._linked = [], 0

    def gap(self, brief: bool) -> None:
        """Something that is no running text stands here."""
        self.rows.extend([Line("", False, brief=brief)] * WINDOW)


class _Element(NamedTuple):
    tag: str
    apart: bool
    brief: bool
    main: bool
    number: int


class _Open:
    """The open elements, and what they make of the text within."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.apart = self.main = self.links = self._number = 0

    def push(self, tag: str, apart: bool, brief: bool, main: bool) -> None:
        self._number += 1
        self.stack.append(_Element(tag, apart, brief, main, self._number))
        self.apart, self.main, self.links = self.apart + apart, self.main + main, self.links + (tag == "a")

    def pop(self) -> _Element:
        e = self.stack.pop()
        self.apart, self.main, self.links = self.apart - e.apart, self.main - e.main, self.links - (e.tag == "a")
        return e

    def path(self) -> tuple[int, ...]:
        return tuple(e.number for e in self.stack if e.tag in _CONTAINERS)

    def innermost(self, tags: tuple[str, ...], scopes: frozenset = frozenset()) -> int | None:
        """Depth of the last open element of these, unless one of ``scopes`` is further in."""
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag in tags:
                return depth
            if self.stack[depth].tag in scopes:
                return None
        return None


def page_lines(html: str, names: bool = True) -> list[Line]:
    """The lines of a page that markup, or with ``names`` a class or id, does not set apart."""
    lines, open_, at = _Lines(), _Open(), 0

    def close(depth: int) -> None:
        while len(open_.stack) > depth:
            if open_.stack[-1].tag in _BLOCK:
                lines.end(open_)
            e = open_.pop()
            if e.apart and e.tag in _BLOCK:
                lines.gap(e.brief)

    while at < len(html):
        found = _TAG.search(html, at)
        until = found.start() if found else len(html)
        if until > at and not open_.apart:
            lines.add(html[at:until], open_.links > 0)
        if found is None:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            depth = open_.innermost((tag,))
            if depth is not None:
                close(depth)
            elif tag in _BLOCK:
                lines.end(open_)
            continue
        if tag in _BLOCK:
            lines.end(open_)
            ends = _CLOSED_BY_ITS_LIKE.get(tag, ()) + (("p",) if tag != "br" else ())
            if ends and (depth := open_.innermost(ends, _SCOPES)) is not None:
                close(depth)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        kind = _kind(tag, found[3] or found[6] or "", open_.main > 0, names)
        if kind[2] and open_.apart:  # an article does not end with what was never closed before it
            depth = next(d for d, e in enumerate(open_.stack) if e.apart)
            if not re.compile(f"</{open_.stack[depth].tag}[\\s/>]", re.I).search(html, at):
                close(depth)
        open_.push(tag, *kind)
    lines.end(open_)
    return lines.rows


def _stretches(length: list[int]) -> list[tuple[int, int, int]]:
    """Lines from surge to dive of the window sums: begin, end and the largest sum."""
    sums = [sum(length[i : i + WINDOW]) for i in range(len(length))]
    found: list[tuple[int, int, int]] = []
    begin = None
    for i, total in enumerate([*sums, 0]):
        if begin is None and total:
            begin = i
        elif begin is not None and not total:
            found.append((begin, i, max(sums[begin:i])))
            begin = None
    return found


def _beside_kept(rows: list[Line], kept: tuple[int, int], other: tuple[int, int]) -> bool:
    """Does a short stretch go on with the kept one, what stands between being set apart?

    It does as a heading, and within the container of the kept lines. Where what stands
    between only interrupts, such as an advert, a container around both is enough;
    the page's body is none.
    """
    before = other[0] < kept[0]
    between = rows[other[1] : kept[0]] if before else rows[kept[1] : other[0]]
    if any(line.text and not line.linked for line in between):
        return False
    own = [rows[i].path for i in range(*kept) if rows[i].text]
    theirs = [rows[i].path for i in range(*other) if rows[i].text and not rows[i].linked]
    home = commonprefix(own)
    around = commonprefix([home, *theirs])
    if around and (around == home or all(line.brief for line in between if not line.text)):
        return True
    near = rows[other[0]] if not before else next(line for line in reversed(rows[other[0] : other[1]]) if line.text)
    return before and near.heading and all(line.brief for line in between if not line.text)


def _text_of(rows: list[Line]) -> str:
    inside = sum(len(line.text) for line in rows if line.main)
    running = [0 if line.linked else len(line.text) for line in rows]
    outside = [0 if line.main else n for line, n in zip(rows, running)]
    beside = sum(sum(outside[a:z]) for a, z, most in _stretches(outside) if most >= SURGE) if inside else 0
    if inside and (beside <= inside or beside < PROSE):
        shown = [line.main for line in rows]
        at = 0
        for has_text, run in groupby(rows, key=lambda line: bool(line.text)):  # up to what is set apart
            lines = list(run)
            span = range(at, at + len(lines))
            at += len(lines)
            if has_text and any(line.main for line in lines):
                for main, part in groupby(span, key=lambda i: rows[i].main):
                    here = list(part)
                    if not main and sum(running[i] for i in here) >= 2 * SURGE:  # goes on outside of its mark
                        for i in here:
                            shown[i] = not rows[i].linked
        return " ".join(line.text for line, yes in zip(rows, shown) if yes and line.text)

    spans = _stretches(running)
    # from the first line with running text to the last one
    stretches = [(next(i for i in range(a, z) if running[i]), z) for a, z, _ in spans]
    surging = [n for n, (_, _, most) in enumerate(spans) if most >= SURGE]
    if surging:
        first, last = surging[0], surging[-1]
        whole = (stretches[first][0], stretches[last][1])
        while first > 0 and _beside_kept(rows, whole, stretches[first - 1]):
            first -= 1
            whole = (stretches[first][0], whole[1])
        while last + 1 < len(stretches) and _beside_kept(rows, whole, stretches[last + 1]):
            last += 1
            whole = (whole[0], stretches[last][1])
        kept = stretches[first : last + 1]
    else:
        kept = [max(stretches, key=lambda s: sum(running[s[0] : s[1]]))] if stretches else []
    return " ".join(rows[i].text for a, z in kept for i in range(a, z) if rows[i].text)


def main_text(html: str | None) -> str:
    """The running text of a page, its blocks joined by one space.

    The distribution is that of text length over the page's lines, where a line ends
    with a block element. What markup sets apart counts as empty lines, and so do lines
    that are mostly links. Sums over windows of lines surge where running text begins and
    dive to zero where it ends. A stretch between surge and dive is kept if a window in
    it has the length of running text, if it lies between two such, or if it goes on
    with one in the same container; the longest stretch is if none has. A line of links
    within a kept stretch stays. Where the page marks its article, all of it is kept, and
    of what is outside only running text that goes on from it. If the stretches of running
    text outside hold more than the marked text, and ``PROSE`` characters or more, the
    marks are those of cards. Classes and ids are looked at unless that leaves nothing.
    """
    text = _text_of(page_lines(html or ""))
    return text or _text_of(page_lines(html or "", names=False))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row, text`` for every row: its own columns as a struct, and the page's main text.

    Whole pages are read, each on its own, and nothing is shuffled. Character
    references are decoded; cut-off markup at the end of a page is dropped. A
    missing or empty page, or one without text, has an empty text; repeated rows
    stay; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    row = F.struct(*[col(c) for c in pages.columns])
    shape = T.StructType([T.StructField("row", pages.schema), T.StructField("text", T.StringType())])
    return arrow_map(pages.select(row.alias("row"), text_or_empty(html_col).alias("html")), run, shape)
