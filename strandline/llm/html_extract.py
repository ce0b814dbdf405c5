"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into lines, one for each block of text, with the
characters and tags of each. Containers that say what they are (menus, headers, footers, sidebars, notices,
adverts, forms, comments, scripts, styles) are left out, but for a form around most of the page. Of the other
lines, smoothed text-to-tag ratios above a threshold are content, and the clusters that they form choose the
regions. From the body inwards, the container that holds nearly all the content is gone into, so that what stands
beside it goes. There each container is selected from its first to its last content line, with what stands
between, with the headings right before, and with whole lists, tables and headings that hold a content line; an
article or main element with a content line is selected whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_texts

# Element names of HTML by their part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button".split())
ASIDE = frozenset("nav header footer aside dialog menu fieldset".split())
REGION = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that are parts of the container around them.
PART = frozenset("address blockquote caption dl figcaption figure h1 h2 h3 h4 h5 h6 hgroup ol pre summary table tbody tfoot thead ul".split())
#: Words in class, id or role that mark a container as no part of the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "footer form header hidden masthead menu menubar modal nav navbar navigation navigate newsletter notice notices pagination pager popup promo "
    "related reply replies respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo alert dialog".split()
)
#: Words that may stand beside these in a name, as in main-nav or comment-list; other words make it another thing, as in share-price.
PLAIN = frozenset(
    "area article bar blog block body bottom box button buttons container content entry global group icon icons inner item items left link links list main "
    "outer page post posts primary right row secondary section site text title top wrap wrapper".split()
)
#: Names of articles that are no part of the article.
REMARK = frozenset("comment comments reply replies related".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose end tag may be left out, and the ends that close them.
LOOSE = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

#: Standard deviation, in lines, of the smoothing, and its reach.
SIGMA, REACH = 1.0, 3

#: Share of the content that a container holds if what stands beside it is no part of the article, and of the text that
#: a form holds if it is the page itself.
NEARLY_ALL, MOST = 0.9, 0.5

_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _names(value: str) -> bool:
    """True if a whole name among those of a class or id is made of such words, one at least of them in MARKED."""
    for name in value.lower().split():
        words = _WORD.findall(name)
        if not MARKED.isdisjoint(words) and all(w in MARKED or w in PLAIN for w in words):
            return True
    return False


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value and _names(value):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Line(NamedTuple):
    """A block of text: tags since the line before; its container; the list, table or heading in it that holds the line, or 0, and
    whether that is a heading; the outermost form around it, or 0."""

    text: str
    tags: int
    box: int
    part: int
    heading: bool
    form: int


class Lines(HTMLParser):
    """The lines of a page, and of each container the one around it and whether it is an article or main element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # name, left out, outermost form, number, container
        self.around: dict[int, int] = {}
        self.regions: set[int] = set()
        self.text: list[str] = []
        self.tags = self.seen = 0

    def end_line(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            box = part = 0
            found = heading = False
            for name, _, _, n, _ in reversed(self.open):
                if name in PART:  # the outermost inside a cell, or the table of the cell
                    part, heading = (part, heading) if found else (n, name in HEADING)
                elif name in ("td", "th"):
                    found = part > 0
                elif name in BLOCK and name not in LOOSE:
                    box = n
                    break
            self.lines.append(Line(text, self.tags, box, part, heading, self.open[-1][2] if self.open else 0))
            self.tags = 0
        self.text = []

    def out(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")  # no block of its own, but it parts words
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in LOOSE and tag in LOOSE[name]:
                del self.open[k:]
                break
            if name in BLOCK:
                break
        self.seen += 1
        out, form = self.out(), self.open[-1][2] if self.open else 0
        if not out and tag not in ("html", "body"):
            if tag in REGION:
                out = any(k == "class" and v and not REMARK.isdisjoint(v.lower().split()) for k, v in attrs)
            else:
                out = tag in HIDDEN or tag in ASIDE and not (tag == "header" and any(x[0] in REGION for x in self.open)) or _marked(attrs)
        box = self.open[-1][4] if self.open else 0
        if tag in BLOCK and tag not in LOOSE and tag not in PART:
            self.around[self.seen] = box
            box = self.seen
            if tag in REGION:
                self.regions.add(box)
        self.open.append((tag, out, form or (self.seen if tag == "form" else 0), self.seen, box))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if self.open[k][0] in ("body", "article", "main") and tag not in ("html", "body"):
                break  # an end tag without its start inside this element

    def handle_data(self, data):
        if not self.out():
            self.text.append(data)


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters over tags of each line, at least one tag, smoothed by a Gaussian over neighbouring lines."""
    r = np.array([len(x.text) / max(1, x.tags) for x in lines])
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(r, k)[REACH:-REACH] / np.convolve(np.ones(len(r)), k)[REACH:-REACH]


def content(lines: list[Line]) -> np.ndarray:
    """True for lines whose smoothed ratio reaches the threshold: half the mean, at most the standard deviation."""
    smooth = ratios(lines)
    return smooth >= min(max(smooth.std(), 1e-9), smooth.mean() / 2)


def selected(page: Lines, lines: list[Line], good: np.ndarray) -> list[int]:
    """Places of the lines of the regions that the clusters of content lines choose."""
    around = page.around
    mass: dict[int, int] = defaultdict(int)
    for i in np.flatnonzero(good).tolist():
        mass[lines[i].box] += len(lines[i].text)
    inner: dict[int, list[int]] = defaultdict(list)
    for box in sorted(around, reverse=True):  # inner containers come after outer ones
        if box in mass:
            mass[around[box]] += mass[box]
            inner[around[box]].append(box)
    core = 0
    while core not in page.regions:
        within = [box for box in inner[core] if mass[box] >= NEARLY_ALL * mass[core]]
        if not within:
            break
        core = within[0]
    # the articles of the core: each with a content line is whole
    whole = {r for r in page.regions if mass.get(r)}
    parts = {(lines[i].box, lines[i].part) for i in np.flatnonzero(good).tolist() if lines[i].part}
    own: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lines):
        own[x.box].append(i)
    span: dict[int, tuple[int, int]] = {}
    for box, at in own.items():
        hit = [k for k, i in enumerate(at) if good[i] or (box, lines[i].part) in parts]
        if hit:
            k = hit[0]
            while k and lines[at[k - 1]].heading:
                k -= 1
            span[box] = at[k], at[hit[-1]]
    # of each container of the core: whether it is in a whole one, and the next one outwards that has a span
    state: dict[int, tuple[bool, int]] = {core: (core in whole, core if core in span else -1)}
    for box in sorted(around):
        if box not in state and around[box] in state:
            taken, next_ = state[around[box]]
            state[box] = taken or box in whole, box if box in span else next_

    def within_span(i: int, box: int) -> bool:
        box = state[box][1]
        while box >= 0:
            if span[box][0] <= i <= span[box][1]:
                return True
            box = state[around[box]][1] if box != core else -1
        return False

    return [i for i, x in enumerate(lines) if x.box in state and (state[x.box][0] or within_span(i, x.box))]


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by a newline."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    size: dict[int, int] = defaultdict(int)
    for x in page.lines:
        size[x.form] += len(x.text)
    total = sum(size.values())
    lines = [x for x in page.lines if not x.form or size[x.form] > MOST * total]
    if not lines:
        return ""
    return "\n".join(lines[i].text for i in selected(page, lines, content(lines)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    Null or empty html, or html without content, gives an empty text. Rows are mapped one by one from the
    whole html, however long; repeats, ties and other columns need no rule; an empty table gives no rows.
    A <br> parts words inside its block and makes no block.
    """
    slim = pages.select("page_id", "url", F.col("html").alias("text"))
    texts = map_texts(slim, "text string", lambda: lambda pages: [[main_text(h) for h in pages]], carry=("page_id", "url"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
