"""Main text of web pages from a stream of parser events.

The standard library's parser turns a page into events; nothing like a tree is
kept.  Block-level tags end a *line*, and every line knows its characters, the
tags seen since the line before, the characters inside links, and the regions that are
open around it.  The ratio of text to tags per line is smoothed with a Gaussian
over neighbouring lines; two-means clustering of the smoothed ratios sets the
threshold between content and the rest.  The content region is the
article (or main) element that holds most of the text above the threshold; a page without
one falls back on the smallest region that holds all of it, with the h1 around that region.
Every line of the chosen regions is kept, short ones too, except what lies in
menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments, which are told by their element, role, class or id.

A class or id counts where it names the element: as a whole word of it or as its last part, before words
such as -list or -box.  Names of layouts (has-sidebar, right-sidebar) and ids of headings, or of
sections of an article, do not count.  Whether an element so told is dropped is decided
at the end of the page (``dropped``), whatever its size: it stays only if it wraps the article, or if the page has no
prose without it.

Each page is worked on for itself, so the job is one pass without a shuffle.

Edge cases: null and empty pages, and pages of tags only, give an empty text;
unclosed and wrongly nested tags, cut-off pages and stray end tags are read as
far as they go; text outside any tag is a line like others; character references are decoded,
unknown ones stay as they are; white space inside a block, no-break spaces included, becomes one
space; repeated rows and null ids come back once per row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import read

SIGMA = 1.0  # of the Gaussian, in lines
SHARE = 0.5  # a region must hold this share of the text above the threshold
PROSE = 20  # characters outside links a tag: a line of sentences, not a date, a name or a label

OTHER = "article of others"  # on the stack, an article that is not the page's own
BLOCKS = {OTHER} | frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "text tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end when another block begins, so an open one does not swallow what follows.
IMPLIED = frozenset("p li dt dd tr td th option".split())
HIDDEN = frozenset("script style noscript template head title iframe object canvas audio video datalist annotation annotation-xml desc metadata".split())
ASIDE = frozenset("nav header footer aside form menu button select textarea dialog search".split())
REGIONS = frozenset("article main section div td body".split())
ARTICLES = frozenset(("article", "main"))
WHOLE = ARTICLES | {"html", "body"}  # never told as no content
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
ADVERTS = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr")  # no wrapper of content has these names
COMMENTS = re.compile(r"comments?|commentlist|disqus|replies|respond")
MARKS = re.compile(
    rf"{ADVERTS.pattern}|banner|notice|alert|popup|modal|overlay|newsletter|subscri\w+|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|masthead|toolbar|pagination|pager|share|sharing|social|related|"
    rf"recommend\w*|login|signup|widget|skip|copyright|legal|{COMMENTS.pattern}"
)
# Articles that are not the page's own.
OTHERS = re.compile(rf"{ADVERTS.pattern}|related|recommend\w*|{COMMENTS.pattern}")
LAYOUT = frozenset("has with without no left right".split())  # begin the name of a layout, not of what it lays out
# End the name of an element whose kind stands before them.
HOLDERS = frozenset("area bar block body box button buttons container form icons inner item items link links list posts section thread".split())
PARTS = re.compile(r"[-_]+")
SPACE = re.compile(r"\s+")


def named(value: str) -> str:
    """The mark among the names of a class or id, or nothing."""
    for name in value.lower().split():
        parts = [x for x in PARTS.split(name) if x]
        if not parts or parts[0] in LAYOUT:
            continue
        while len(parts) > 1 and (parts[-1] in HOLDERS or parts[-1].isdigit()):
            parts.pop()
        if MARKS.fullmatch(parts[-1]):
            return parts[-1]
    return ""


class Mark:
    """An element told as no content."""

    def __init__(self, parent: int, kind: str, inside: bool):
        self.parent = parent  # the mark around it, or -1
        self.kind = kind  # "name" (also forms), "element", "advert" or "comments"
        self.inside = inside  # in an article or main
        self.article = self.main = False  # whether it holds one


class Lines(HTMLParser):
    """Collects lines from events; state is the stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int]] = []  # element, region, 1 if it is hidden, mark
        self.open: Counter[str] = Counter()  # elements on the stack
        self.region = 0
        self.off = 0
        self.mark = -1
        self.marks: list[Mark] = []
        self.parents = [-1]
        self.elements = [""]
        self.parts: list[tuple[str, int, bool]] = []  # text, mark, in a link
        self.tags = 0
        self.anchors = 0
        self.articles = 0
        self.titles = 0
        self.raw: list[tuple[list[tuple[str, int, bool]], int, int, bool]] = []  # parts, tags, region, in an h1

    def end_line(self) -> None:
        if self.parts:
            self.raw.append((self.parts, self.tags, self.region, self.titles > 0))
            self.parts, self.tags = [], 0

    def lines(self, gone: list[bool]) -> list[tuple[str, int, int, int, bool]]:
        """Text, tags, characters in links, region, in an h1 of every line, without the marks that are gone."""
        out, tags = [], 0
        for parts, n, region, title in self.raw:
            tags += n
            kept = [x for x in parts if x[1] < 0 or not gone[x[1]]]
            text = SPACE.sub(" ", "".join(x[0] for x in kept)).strip()
            if text:
                out.append((text, tags, sum(len(x[0]) for x in kept if x[2]), region, title))
                tags = 0
        return out

    def leave(self, at: int) -> None:
        """Close the elements from this place of the stack on."""
        for name, region, off, mark in reversed(self.stack[at:]):
            self.off -= off
            self.open[name] -= 1
            self.anchors -= name == "a"
            self.articles -= name in ARTICLES
            self.titles -= name == "h1"
            self.region, self.mark = region, mark
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.stack and self.stack[-1][0] in IMPLIED and (tag == self.stack[-1][0] or self.stack[-1][0] == "p"):
                self.leave(len(self.stack) - 1)
            elif tag == "p":
                # Inline elements left open do not keep a paragraph open.
                at = len(self.stack)
                while at and self.stack[at - 1][0] not in BLOCKS:
                    at -= 1
                if at and self.stack[at - 1][0] == "p":
                    self.leave(at - 1)
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        off = tag in HIDDEN
        kind = "" if off or tag in WHOLE and tag != "article" else self.kind(tag, attrs)
        own = not kind and tag in ARTICLES
        # An article that is not the page's own is a region like others.
        name = "div" if tag in ARTICLES and not own else tag
        self.stack.append((name if name == tag else OTHER, self.region, int(off), self.mark))
        self.open[self.stack[-1][0]] += 1
        if kind:
            self.marks.append(Mark(self.mark, kind, self.articles > 0))
            self.mark = len(self.marks) - 1
        self.off += off
        self.anchors += tag == "a"
        self.titles += tag == "h1"
        if own:
            self.articles += 1
            at = -1 if self.off else self.mark
            while at >= 0 and not (self.marks[at].article and (self.marks[at].main or tag != "main")):
                self.marks[at].article = True
                self.marks[at].main |= tag == "main"
                at = self.marks[at].parent
        if tag in REGIONS:
            self.parents.append(self.region)
            self.elements.append(name)
            self.region = len(self.parents) - 1

    def kind(self, tag: str, attrs: list) -> str:
        """Of the mark this element is, or nothing."""
        if tag in ASIDE:
            return "name" if tag == "form" else "element"
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and UNSEEN.search(value):
                return "element"
            if name == "role" and tag != "article" and value and value.lower() in ROLES:
                return "element"
        for name, value in attrs:
            if name == "class" or name == "id" and tag not in HEADINGS and not (tag == "section" and self.articles):
                if value and (mark := named(value)):
                    if COMMENTS.fullmatch(mark):
                        return "comments"
                    if tag == "article":
                        return "name" if OTHERS.fullmatch(mark) else ""
                    return "advert" if ADVERTS.fullmatch(mark) else "name"
        return ""

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self.open[tag] and not (tag == "article" and self.open[OTHER]):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag or tag == "article" and self.stack[at][0] == OTHER:
                self.leave(at)
                return
            if tag not in BLOCKS and self.stack[at][0] in BLOCKS:
                return  # an inline end tag closes nothing beyond its block

    def handle_data(self, data: str) -> None:
        if not self.off:
            self.parts.append((data, self.mark, self.anchors > 0))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of neighbouring lines."""
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    n = len(ratios)
    total = np.convolve(ratios, kernel)[reach : reach + n]
    return total / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """Boundary between the lower and the upper of two clusters (two-means in one dimension)."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            break
        means = values[~upper].mean(), values[upper].mean()
        if means == (low, high):
            break
        low, high = means
    return (low + high) / 2


def strong(lines: list[tuple[str, int, int, int, bool]], alone: bool = False) -> np.ndarray:
    """Characters of each line above the threshold, 0 of the others.

    ``alone``: also of a line that would be above it without its neighbours and with no more tags than content
    lines usually have; the only paragraph of a section has weak neighbours and the tags of the section.
    """
    n = np.array([len(line[0]) for line in lines], dtype=float)
    tags = np.array([max(line[1], 1) for line in lines], dtype=float)
    links = np.array([line[2] for line in lines], dtype=float)
    ratio = smoothed(np.maximum(n - links, 0) / tags)
    least = threshold(ratio)
    above = ratio >= least
    if alone:
        above |= n - links >= least * np.median(tags[above])
    return np.where(above, n, 0)


def dropped(page: Lines) -> list[bool]:
    """Whether each mark's text goes.

    It stays if the mark holds the main element; if it holds an article and no article shows
    without it; or if it holds most of the text above the threshold of a page (a mark in an article: of an article)
    that has no prose outside all marks.  How long it is does not matter as long as there is other prose.  Adverts stay
    only around an article, menus, headers, footers, sidebars and the like only around the one with most of
    that text, comments only around a main.
    """
    marks = page.marks
    if not marks:
        return []

    def chained(own: list[bool]) -> list[bool]:
        for i, m in enumerate(marks):
            own[i] |= m.parent >= 0 and own[m.parent]
        return own

    gone = chained([not (m.main or m.kind == "name" or m.article and m.kind in ("element", "advert")) for m in marks])
    lines = page.lines(gone)
    if not lines:
        return gone
    held, total, weights = [0.0] * len(marks), 0.0, iter(strong(lines))
    inner = in_articles(page)
    for parts, _, _, _ in page.raw:
        kept = [(len(text.strip()), mark) for text, mark, _ in parts if mark < 0 or not gone[mark]]
        size = sum(n for n, _ in kept)
        if not size:
            continue
        weight = next(weights) / size
        total += weight * size
        for n, mark in kept:
            if mark >= 0:
                held[mark] += weight * n
    for i in range(len(marks) - 1, -1, -1):
        if marks[i].parent >= 0:
            held[marks[i].parent] += held[i]
    rest = page.lines([True] * len(marks))
    shown = any(inner[region] for _, _, _, region, _ in rest)
    prose = [region for text, tags, linked, region, title in rest if not title and len(text) - linked >= PROSE * max(tags, 1)]
    left = {True: any(inner[r] for r in prose), False: shown or bool(prose)}

    def stays(m: Mark, share: float) -> bool:
        if m.main:
            return True
        if m.kind in ("name", "advert") and m.article and not shown:
            return True
        most = share > SHARE * total and not left[m.inside]
        return most and (m.kind == "name" or m.kind == "element" and m.article)

    return chained([not stays(m, share) for m, share in zip(marks, held)])


def in_articles(page: Lines) -> list[bool]:
    """Whether each region is, or lies in, an article or main; regions are numbered from the outside in."""
    inner = [False] * len(page.parents)
    for r, element in enumerate(page.elements):
        inner[r] = element in ARTICLES or r > 0 and inner[page.parents[r]]
    return inner


def held_by_region(page: Lines, lines: list[tuple[str, int, int, int, bool]], weights: np.ndarray) -> np.ndarray:
    """Text above the threshold in each region and all it contains."""
    held = np.zeros(len(page.parents))
    for (_, _, _, region, _), weight in zip(lines, weights):
        held[region] += weight
    for region in range(len(held) - 1, 0, -1):
        held[page.parents[region]] += held[region]
    return held


def content(page: Lines) -> str:
    lines = page.lines(dropped(page))
    if not lines:
        return ""
    held = held_by_region(page, lines, strong(lines))
    inner = in_articles(page)
    outer = [r for r, e in enumerate(page.elements) if e in ARTICLES and not inner[page.parents[r]]]
    around: set[int] = set()
    if not outer or held[outer].sum() < SHARE * held[0] or held[0] == 0:
        # The smallest region that holds all of it, walking down from the page.
        held = held_by_region(page, lines, strong(lines, alone=True))
        chosen = 0
        for r in range(1, len(page.parents)):
            if page.parents[r] == chosen and held[r] == held[0] > 0:
                chosen = r
        outer = [chosen]
        while (chosen := page.parents[chosen]) >= 0:
            around.add(chosen)
    kept = [False] * len(page.parents)
    for r in outer:
        kept[r] = True
    for r in range(1, len(kept)):
        kept[r] |= kept[page.parents[r]]
    return "\n".join(
        text for text, _, linked, region, title in lines if kept[region] or title and region in around and linked < len(text)
    )


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    return content(page)


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: html last of the columns -> the other columns and the text."""
    for batch in batches:
        pages = batch.column(batch.num_columns - 1)
        texts = [main_text(p.as_py()) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"]
        )


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text``."""
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("html"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(text_rows, f"{names}, text string")


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
