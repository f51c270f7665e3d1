"""HTML and XHTML as block rows, by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import arrow_schema, batched_rows

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe object svg canvas audio video button select textarea".split())
BOXES = frozenset("p div section article main header footer aside nav ul ol li table tr td th thead tbody tfoot caption blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 dl dt dd form body html hr".split())
STYLE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "ins": "underline", "s": "strikethrough", "del": "strikethrough", "strike": "strikethrough", "sup": "superscript", "sub": "subscript"}

BLOCK_SCHEMA = "idx int, type string, level int, text string, html string, href string, ordered boolean"


class Projector(HTMLParser):
    """Collects (type, level, text, html, href, ordered) of headings, paragraphs, list items, tables, code and pictures."""

    def __init__(self, base: str | None = None):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.stack = base, [], []
        self.text: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[str] = []
        self.table: list[list[tuple[str, str, int, int]]] | None = None
        self.cell: tuple[str, int, int] | None = None
        self.depth = 0
        self.link: str | None = None
        self.title: list[str] = []
        self.meta: dict[str, str] = {}
        self.lang: str | None = None

    def _end(self, kind: str = "text", level: int | None = None) -> None:
        raw = "".join(self.text)
        self.text = []
        text = raw.strip("\n") if kind == "code" else " ".join(raw.split())
        if self.table is not None and kind != "caption":
            if self.cell and text:
                self.text = [text + " "]
            return
        if text:
            if kind == "text" and self.lists:
                kind, level = "list_item", len(self.lists)
            ordered = bool(self.lists and self.lists[-1] == "ol") if kind == "list_item" else None
            self.out.append((kind, level, text, None, self.link, ordered))
        self.link = None

    def _kind(self) -> tuple[str, int | None]:
        for tag in reversed(self.stack):
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return ("doc_title" if tag == "h1" else "paragraph_title"), int(tag[1])
            if tag == "pre":
                return "code", None
            if tag in ("header", "footer", "nav", "aside"):
                return {"nav": "index", "aside": "aside_text"}.get(tag, tag), None
            if tag in ("figcaption", "caption"):
                return "caption", None
            if tag == "blockquote":
                return "quote", None
        return "text", None

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "html":
            self.lang = given.get("lang")
        if tag == "meta" and (given.get("property") or given.get("name")) and given.get("content"):
            self.meta.setdefault((given.get("property") or given.get("name")).lower(), given["content"])
        if tag == "base" and given.get("href") and not self.base:
            self.base = given["href"]
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BOXES:
            self._end(*self._kind())
            if tag == "p":
                self._close("p", BOXES)
            elif tag == "li":
                self._close("li", ("ul", "ol"))
        if tag == "br":
            self.text.append("\n" if "pre" in self.stack else " ")
        elif tag == "img":
            self.out.append(("image", None, given.get("alt") or "", None, self._url(given.get("src")), None)) if self.table is None else None
        elif tag == "a":
            self.link = self._url(given.get("href")) or self.link
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
        elif tag == "table":
            self.depth += 1
            if self.table is None:
                self.table = []
        elif self.table is not None and tag == "tr" and self.depth == 1:
            self._cell()
            self.table.append([])
        elif self.table is not None and tag in ("td", "th") and self.depth == 1:
            self._cell()
            self.cell = (tag, _span(given.get("rowspan")), _span(given.get("colspan")))
        if tag not in VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _url(self, url):
        return urljoin(self.base, url) if url and self.base else url

    def _close(self, tag, stop):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                del self.stack[k:]
                return
            if self.stack[k] in stop and self.stack[k] != tag:
                return

    def _cell(self):
        if self.cell is not None:
            if not self.table:
                self.table.append([])
            self.table[-1].append((self.cell[0], " ".join("".join(self.text).split()), self.cell[1], self.cell[2]))
        self.cell, self.text = None, []

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in BOXES and tag not in ("td", "th", "tr", "table"):
            self._end(*self._kind())
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if self.table is not None and tag in ("td", "th", "tr") and self.depth == 1:
            self._cell()
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._cell()
                rows, self.table = self.table, None
                if any(rows):
                    self.out.append(("table", None, "\n".join("\t".join(c[1] for c in r) for r in rows if r), table_html(rows), None, None))
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title":
            self.title.append(data)
        elif not self.skip and "head" not in self.stack:
            self.text.append(data)

    def finish(self) -> list[tuple]:
        self.close()
        self._end(*self._kind())
        return self.out


def _span(value: str | None) -> int:
    return min(1000, max(1, int(value))) if value and value.strip().isdigit() else 1


def table_html(rows: list[list[tuple[str, str, int, int]]]) -> str:
    """A table element from rows of (tag, text, rowspan, colspan)."""
    def one(c):
        spans = (f' rowspan="{c[2]}"' if c[2] > 1 else "") + (f' colspan="{c[3]}"' if c[3] > 1 else "")
        return f"<{c[0]}{spans}>{escape(c[1])}</{c[0]}>"

    return "<table>" + "".join("<tr>" + "".join(map(one, r)) + "</tr>" for r in rows if r) + "</table>"


def html_blocks(html: str | None, base: str | None = None) -> list[tuple]:
    """The blocks of a page: (idx, type, level, text, html, href, ordered)."""
    p = Projector(base)
    p.feed(html or "")
    return [(k, *b) for k, b in enumerate(p.finish())]


def read_blocks(pages: DataFrame, key: str, html: str = "html", base: str | None = None) -> DataFrame:
    """(key, blocks) rows of ``pages``, one block a row: parsed in Arrow batches, no shuffle."""
    kind = pages.schema[key].dataType.simpleString()

    schema = f"{key} {kind}, {BLOCK_SCHEMA}"
    arrow = arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, h, u in zip(*batch.columns):
                k = k.as_py()
                yield from [(k, *b) for b in html_blocks(h.as_py(), u.as_py())]

    url = F.col(base) if base else F.lit(None).cast("string")
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h"), url.alias("u")).mapInArrow(lambda batches: batched_rows(rows(batches), arrow), schema)


def title(html: Column) -> Column:
    """The page's title: og:title, else the title element; white space single."""
    og = F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    own = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(F.when(og != "", og).otherwise(own), r"\s+", " "))


def language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']([A-Za-z-]+)["']""", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space single."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def safe_link(url: Column) -> Column:
    """An http, https, mailto or ftp link, or a relative one; null with another scheme, user information or control characters."""
    bad = url.rlike(r"[\x00-\x20\x7f]") | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(~bad & scheme.isin("", "http", "https", "mailto", "ftp"), url)
