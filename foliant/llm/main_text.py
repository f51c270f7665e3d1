"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video form fieldset button select option textarea input label".split())
ASIDE = frozenset("nav menu aside footer header dialog".split())
CONTAINER = frozenset("article main div body td".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements whose start ends an open one of these, unless one of the second row stands between.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
# Words of class, id and role that mark what isn't content.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored sponsors promo promoted promotion"
    " cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login comment comments respond disqus discussion"
    " sidebar sidenav menu nav navbar navigation navigate breadcrumb breadcrumbs topbar toolbar masthead header footer foot colophon"
    " share sharing social related recommended recommendations recirc widget popup modal overlay pagination pager search searchform"
    " contentinfo complementary skip hidden outbrain taboola copyright legal disclaimer".split()
)
_TOKEN = re.compile(r"[a-z0-9]+")
#: What a line's ratio counts inside an element named as boilerplate, and outside the article or main element where a page has one.
NAMED, OUTSIDE = 0.02, 0.05
#: A region is content from these shares of the largest mass and of the densities.
MASS, DENSITY = 0.3, 1 / 6
#: So many lines of links in a row are a menu.
MENU = 3
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Line:
    """A block's text with what stands around it."""

    text: str
    tags: int
    linked: int
    container: int
    article: int
    heading: bool
    named: bool = False


@dataclass(slots=True)
class _Open:
    tag: str
    dropped: bool
    container: int
    article: int
    soft: bool = False
    named: bool = False


@dataclass(slots=True)
class _State:
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0


class Events(HTMLParser):
    """Turns a page's events into lines, in page order; holds one open block and the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[_Open] = [_Open("", False, 0, 0, False, False)]
        self.block, self.links, self.count = _State(), 0, 0
        self.parents: dict[int, int] = {}

    def flush(self) -> None:
        text = " ".join("".join(self.block.parts).split())
        if text:
            top = self.stack[-1]
            self.lines.append(Line(text, self.block.tags, self.block.linked, top.container, top.article, top.tag in HEADING, top.named))
        self.block = _State()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.block.tags += 1
        if tag in BLOCK:
            self.flush()
            self._end_implied(("p",), BLOCK)
            if tag in IMPLIED:
                self._end_implied(*IMPLIED[tag])
        elif tag == "br":
            self.block.parts.append(" ")
        if tag in VOID:
            return
        if tag in ("article", "main"):
            # an unclosed element named as boilerplate, or hidden, before the article doesn't reach into it
            while len(self.stack) > 1 and self.stack[-1].soft:
                self.stack.pop()
        top = self.stack[-1]
        soft = hidden = False
        if attrs and not top.dropped:
            soft, hidden = self._marked(tag, dict(attrs))
        dropped = top.dropped or tag in DROPPED or hidden
        own = soft or tag in ASIDE
        self.count += 1
        article = top.article or (self.count if tag in ("article", "main") and not dropped and not own else 0)
        container = top.container
        if own or tag in CONTAINER and not top.article:
            container = self.count
            if not own:
                self.parents[container] = top.container
        self.stack.append(_Open(tag, dropped, container, article, soft or hidden, top.named or own))
        if tag == "a":
            self.links += 1

    @staticmethod
    def _marked(tag: str, given: dict[str, str | None]) -> tuple[bool, bool]:
        """(named as boilerplate, hidden) by an element's attributes."""
        marks = set(_TOKEN.findall(" ".join(str(given.get(k) or "") for k in ("class", "id", "role")).lower()))
        inside = tag in ("html", "body", "main") or (tag == "article" and not marks & {"comment", "comments", "ad", "ads", "sponsored", "promo", "related"})
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style") or ""))
        return bool(marks & BOILERPLATE) and not inside, hidden

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in BLOCK:
            self.block.tags += 1
            if tag in BLOCK:
                self.flush()
            elif tag == "br":
                self.block.parts.append(" ")
        else:
            self.handle_starttag(tag, attrs)

    def _pop(self) -> None:
        if len(self.stack) > 1 and self.stack.pop().tag == "a":
            self.links = max(0, self.links - 1)

    def _end_implied(self, tags: tuple[str, ...], stop) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in stop:
                return

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag not in BLOCK and self.stack[k].tag in BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        self.block.tags += 1
        if tag in BLOCK:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.block.parts.append(data)
            if self.links:
                self.block.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; at the ends over what there is."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        k = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(k, values[lo:hi])) / sum(k))
    return out


def ratios(lines: list[Line]) -> list[float]:
    """Each line's unlinked text by its tags, less where its elements say that it is no content."""
    inside = any(x.article for x in lines)
    return [(len(x.text) - min(x.linked, len(x.text))) / x.tags * (NAMED if x.named else 1) * (OUTSIDE if inside and not x.article else 1) for x in lines]


def regions_of(lines: list[Line], parents: dict[int, int]) -> list[int]:
    """Each line's region: its container, or the nearest one above that has more than one line."""
    of = [x.container for x in lines]
    while True:
        count: dict[int, int] = {}
        for c in of:
            count[c] = count.get(c, 0) + 1
        up = [parents[c] if count[c] == 1 and c in parents else c for c in of]
        if up == of:
            return of
        of = up


def content_lines(lines: list[Line], parents: dict[int, int]) -> list[Line]:
    """The lines of the content regions.

    The ratios of a region's lines are smoothed along it; its density is
    their mean by text, its mass density times text. The regions that come
    near the one of the largest mass (``MASS``, ``DENSITY``; an article by its
    density alone) are the content, with all their lines but runs of ``MENU`` and more lines of links. A
    heading right before such a region belongs to it.
    """
    raw, of = ratios(lines), regions_of(lines, parents)
    regions: dict[int, list[int]] = {}
    for k, c in enumerate(of):
        regions.setdefault(c, []).append(k)
    density, mass = {}, {}
    for c, own in regions.items():
        size = sum(len(lines[k].text) for k in own)
        density[c] = sum(r * len(lines[k].text) for r, k in zip(smoothed([raw[k] for k in own]), own)) / size
        mass[c] = density[c] * size
    most = max(mass.values(), default=0.0)
    if not most:
        return []
    dense = max(density[c] for c in regions if mass[c] == most)
    content = {c for c, own in regions.items() if density[c] >= DENSITY * dense and (mass[c] >= MASS * most or lines[own[0]].article)}
    keep = [c in content for c in of]
    for c in content:
        run: list[int] = []
        for k in [*regions[c], -1]:
            if k >= 0 and 2 * lines[k].linked >= len(lines[k].text) and not lines[k].heading:
                run.append(k)
                continue
            if len(run) >= MENU:
                for i in run:
                    keep[i] = False
            run = []
    for k in range(len(lines) - 2, -1, -1):
        if lines[k].heading and keep[k + 1] and not lines[k].named and (lines[k].article or not lines[k + 1].article):
            keep[k] = True
    return [x for x, yes in zip(lines, keep) if yes]


def main_text(html: str | None) -> str:
    """The main text of a page: its content blocks, white space made single, joined by line feeds."""
    if not html:
        return ""
    events = Events()
    events.feed(html)
    events.close()
    events.flush()
    return "\n".join(x.text for x in content_lines(events.lines, events.parents))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    Null and empty pages, and pages without text outside of links, have an
    empty text; very long pages are parsed whole; of regions that tie all are
    content. Repeated rows stay; no rows give no rows; other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
