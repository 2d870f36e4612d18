"""Main text of web pages by text-to-tag ratios.

The standard library's parser sends events of a page's markup one after the other; they make up lines, one a block of
text (a paragraph, a heading, a list item, a table row, loose text between blocks). A line's ratio is its text outside of
links over the tags met since the line before, taken by its logarithm. Lines within menus, headers, footers, sidebars, notices, adverts, forms
and reader comments, as elements, roles or class names tell, count as ratio 0; scripts and styles give no lines. Ratios
are smoothed with a Gaussian, and the threshold that parts them best into two clusters (least squares) tells which lines
seed content.

Where an article or main element has text, lines outside of one seed nothing. The region is the innermost element that holds most of the seeds' text. Of an article or main element all lines stay
that aren't marked as something else, so that its short paragraphs do, too. Of any other element those from the first
seed to the last stay, with headings right before the first; lines between them that are mostly links go.

A block's white space becomes single spaces and is trimmed; br is white space, an inline tag is nothing; cells of a table
row are parted by a space. An article's own header gives its headings alone.

Defined results: null and empty pages, and those without text of their own, have an empty text; unclosed or stray tags
are read as browsers mostly do (a block ends an open paragraph, an end tag without a start is skipped); a construct that
the page ends within is dropped; rows that repeat are each extracted; null ids and urls stay; an empty table gives no
rows; other columns are ignored. A page is worked on whole, in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, text_of, thrifty

# Elements by what they do to text, and names that mark what isn't content.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(["td", "th"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("audio canvas datalist head iframe map math noembed noframes noscript object picture script style svg template title video".split())
ASIDE = frozenset("aside button dialog footer form input menu nav search select textarea".split())
WHOLE = frozenset(["article", "main"])
#: In the head of a page; any other start tag ends the head.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADS = frozenset(["header", "masthead"])
NAME, STATE = re.compile(r"[a-z]+"), re.compile(r"(has|no|with|without|js|is)[-_]")

SIGMA = 1.0
_REACH = np.arange(-3, 4)
_KERNEL = np.exp(-(_REACH**2) / (2 * SIGMA**2))
#: The region holds this share of the seeds' text.
MOST = 0.7


def _marked(tag: str, attrs: list) -> str:
    """What the start tag says about its content: '' or aside, header."""
    if tag in ASIDE:
        return "aside"
    found = "header" if tag == "header" else ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "aside"
        if not value:
            continue
        if name == "role" and value.lower() in ROLES:
            return "aside"
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for own in value.split():
                if STATE.match(own.lower()):
                    continue
                words = NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", own).lower())
                if not MARKS.isdisjoint(words):
                    return "aside"
                if not HEADS.isdisjoint(words):
                    found = "header"
    return found


class Lines(HTMLParser):
    """A page's lines: text, characters outside of links, tags since the line before, heading or not, path of the open
    elements' numbers, and whether it is marked as no content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple] = []
        self.whole: set[int] = set()
        # tag, number, marked as no content, only headings count, unread
        self.open: list[tuple] = [("", 0, False, False, False)]
        self.path: tuple[int, ...] = (0,)
        self.count = self.tags = self.links = self.linked = 0
        self.parts: list[str] = []
        self.heading = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.open[-1]
                self.lines.append((text, max(0, len(text) - self.linked), self.tags, self.heading, self.path, top[2] or (top[3] and not self.heading)))
                self.tags = 0
            self.parts.clear()
        self.linked = 0

    def close_to(self, k: int) -> None:
        del self.open[k:]
        self.path = tuple(x[1] for x in self.open)
        self.heading = any(x[0] in HEADINGS for x in self.open[-2:])

    def find(self, tags, stop=()) -> int:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stop:
                break
        return 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self.close_to(len(self.open) - 1)
        if self.open[-1][4]:
            # A block ends a paragraph with what is open in it.
            k = self.find(("p",), BLOCKS - {"p"}) if tag in BLOCKS else 0
            if not k or self.open[k][4]:
                if tag not in VOID:
                    self.push(tag, False, False, True)
                return
        if tag == "br" or tag in CELLS:
            self.parts.append(" ")
            if tag == "br":
                return
        block = tag in BLOCKS
        if block:
            self.flush()
            if k := self.find(("p",), BLOCKS - {"p"}):
                self.close_to(k)
            if tag in ("li", "dd", "dt", "tr") and (k := self.find(("dd", "dt") if tag[0] == "d" else (tag,), ("ul", "ol", "dl", "table"))):
                self.close_to(k)
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        mark = _marked(tag, attrs) if attrs or tag in ASIDE or tag == "header" else ""
        unread = tag in UNREAD or (mark == "aside" and not block)
        if unread and tag != "head":
            self.parts.append(" ")
        if block or mark or unread or tag == "a":
            own = self.find(WHOLE)
            aside = mark == "aside" or (mark == "header" and not own)
            self.push(tag, aside, mark == "header", unread)
            if tag in WHOLE or ("role", "main") in attrs:
                self.whole.add(self.open[-1][1])

    def push(self, tag, aside, headings, unread):
        top = self.open[-1]
        self.count += 1
        self.open.append((tag, self.count, top[2] or aside, top[3] or headings, top[4] or unread))
        self.path += (self.count,)
        self.heading = self.heading or tag in HEADINGS

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if tag in CELLS:
            self.parts.append(" ")
        k = self.find((tag,))
        if not k:
            return
        # An inline end tag doesn't close a block.
        if tag not in BLOCKS and not self.open[k][4] and any(x[0] in BLOCKS for x in self.open[k + 1 :]):
            return
        if tag in BLOCKS:
            self.flush()
        self.close_to(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "svg", "iframe"):
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.open[-1][4]:
            if self.open[-1][0] == "head" and data.strip():
                self.close_to(len(self.open) - 1)
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))

    def updatepos(self, i, j):
        return j  # lines and columns of the source aren't asked for

    def parse_comment(self, i, report=1):
        k = super().parse_comment(i, report)
        return len(self.rawdata) if k < 0 else k

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)


def parsed(html: str) -> Lines:
    out = Lines()
    k = html.rfind("<")
    if k >= 0 and ">" not in html[k:] and (html[k + 1 : k + 2].isalpha() or html[k + 1 : k + 2] in ("/", "!", "?")):
        html = html[:k]
    out.feed(html)
    out.close()
    out.flush()
    return out


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios under a Gaussian, whose weights at the ends add up to 1, too."""
    padded, there = np.pad(ratios, len(_KERNEL) // 2), np.pad(np.ones(len(ratios)), len(_KERNEL) // 2)
    return np.convolve(padded, _KERNEL, "valid") / np.convolve(there, _KERNEL, "valid")


def threshold(x: np.ndarray) -> float:
    """The least value of the upper of two clusters with the least squares; that of all where there is nothing to part."""
    x = np.sort(x)
    if len(x) < 2 or x[0] == x[-1]:
        return float(x[0])
    n, s = np.arange(1, len(x)), np.cumsum(x)[:-1]
    between = s**2 / n + (x.sum() - s) ** 2 / (len(x) - n)
    between[x[1:] == x[:-1]] = -1.0
    return float(x[int(np.argmax(between)) + 1])


def main_text(html: str) -> str:
    page = parsed(html)
    lines = page.lines
    if not any(not x[5] for x in lines):
        return ""
    ratios = np.array([0.0 if x[5] else x[1] / max(1, x[2]) for x in lines])
    even = smoothed(np.log1p(ratios))
    own = np.array([not x[5] for x in lines])
    within = own & np.array([not page.whole.isdisjoint(x[4]) for x in lines])
    own = within if within.any() else own
    # Short articles among long menus: a line of its own text beats what is only near one.
    seeds = own & (ratios > 0) & (even >= threshold(even))
    if not seeds.any():
        seeds = own & (ratios > 0)
    if not seeds.any():
        seeds = own
    held: dict[int, int] = {}
    depth: dict[int, int] = {}
    for k in np.flatnonzero(seeds):
        for d, e in enumerate(lines[k][4]):
            held[e] = held.get(e, 0) + max(1, lines[k][1])
            depth[e] = d
    region = max((e for e in held if held[e] >= MOST * held[0]), key=lambda e: (depth[e], e))
    # The element may lie in an article, or be a block of one.
    path = next(x[4] for k, x in enumerate(lines) if seeds[k] and region in x[4])
    inside = [e for e in path[: depth[region] + 1] if e in page.whole]
    if inside:
        region = inside[-1]
        return "\n".join(x[0] for x in lines if not x[5] and region in x[4])
    # A lone paragraph is as much of the text as its neighbours: take what holds it.
    while depth[region] and page_block(lines, region):
        region = path[depth[region] - 1]
    here = [k for k, x in enumerate(lines) if region in x[4]]
    at = [k for k in here if seeds[k]]
    first, last = at[0], at[-1]
    while first > here[0] and lines[first - 1][3] and not lines[first - 1][5]:
        first -= 1
    return "\n".join(x[0] for k, x in enumerate(lines) if first <= k <= last and not x[5] and (2 * x[1] >= len(x[0]) or x[3]))


def page_block(lines: list[tuple], element: int) -> bool:
    """True where the element is the last of a line's path, that is, a block of text and not one that holds blocks."""
    return all(x[4][-1] == element for x in lines if element in x[4])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of(pages, "html").alias("html")).mapInArrow(thrifty(run), "page_id long, url string, text string, n_chars long")
