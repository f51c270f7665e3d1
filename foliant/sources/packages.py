"""Office, e-book, mail and rich-text files as block rows, by zipfile, ElementTree and email of the standard library."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.formats import BUILTIN, format_value
from foliant.functions.mathml import omml_to_latex
from foliant.plans.shared import arrow_schema, batched_rows
from foliant.sources import compound, pdf
from foliant.sources.delimited import records
from foliant.sources.detect import suffix_of
from foliant.sources.markup import html_blocks, table_html

#: Bounds of a package: members, and bytes that it may inflate to.
MOST_MEMBERS, MOST_BYTES = 20_000, 1 << 30

SCHEMA = "path string, suffix string, page_idx int, page string, idx int, type string, level int, text string, html string, href string, ordered boolean, error string"


@lru_cache(maxsize=4096)
def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


class Package:
    """A zip file whose members are read within bounds."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if len(self.zip.infolist()) > MOST_MEMBERS or sum(i.file_size for i in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("the package is over its bounds")
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data[:4096] and b"<!ENTITY" in data:
            raise ValueError(f"{name} declares entities")
        return ET.fromstring(data)

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", name + ".rels"))
        if root is None:
            return {}
        return {r.get("Id"): (r.get("Target", "") if r.get("TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, r.get("Target", "")).lstrip("/")), r.get("Type", "")) for r in root}


Block = tuple  # (page_idx, page, type, level, text, html, href, ordered)


def docx(data: bytes) -> Iterator[Block]:
    """Paragraphs with style levels, numbered and bulleted items, tables, links and formulas' text."""
    p = Package(data)
    root = p.xml("word/document.xml")
    links = p.relations("word/document.xml")
    levels = {}
    if (styles := p.xml("word/styles.xml")) is not None:
        for s in styles:
            if local(s.tag) == "style":
                name = next((attr(e, "val") for e in s if local(e.tag) == "name"), "") or ""
                m = re.fullmatch(r"(?i)heading ([1-9])", name)
                levels[attr(s, "styleId")] = int(m[1]) if m else 0 if name.lower() == "title" else None
    ordered = {}
    if (numbering := p.xml("word/numbering.xml")) is not None:
        kinds = {attr(a, "abstractNumId"): next((attr(f, "val") for f in a.iter() if local(f.tag) == "numFmt"), "bullet") for a in numbering if local(a.tag) == "abstractNum"}
        for n in numbering:
            if local(n.tag) == "num":
                ordered[attr(n, "numId")] = kinds.get(next((attr(e, "val") for e in n if local(e.tag) == "abstractNumId"), None)) != "bullet"

    def text(e: ET.Element) -> str:
        out = []
        for x in e.iter():
            t = local(x.tag)
            if t == "t":
                out.append(x.text or "")
            elif t in ("tab", "br", "cr") and e is not x:
                out.append("\t" if t == "tab" else "\n")
        return "".join(out)

    def table(e: ET.Element) -> Block:
        rows = []
        for tr in (x for x in e if local(x.tag) == "tr"):
            row = []
            for tc in (x for x in tr if local(x.tag) == "tc"):
                span = next((attr(g, "val") for g in tc.iter() if local(g.tag) == "gridSpan"), "1")
                merge = next((attr(g, "val") or "continue" for g in tc.iter() if local(g.tag) == "vMerge"), None)
                row.append(["td", "\n".join(filter(None, (text(q) for q in tc if local(q.tag) == "p"))), 0 if merge == "continue" else 1, int(span or 1)])
            rows.append(row)
        for r, row in enumerate(rows):  # a continued cell lengthens the one above
            for c in row:
                if not c[2]:
                    at = sum(x[3] for x in row[: row.index(c)])
                    for up in reversed(rows[:r]):
                        hit = next((x for k, x in enumerate(up) if sum(y[3] for y in up[:k]) == at and x[2]), None)
                        if hit:
                            hit[2] += 1
                            break
        rows = [[tuple(c) for c in row if c[2]] for row in rows]
        return 0, "", "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None

    body = next((e for e in root if local(e.tag) == "body"), [])
    for e in body:
        if local(e.tag) == "tbl":
            yield table(e)
        elif local(e.tag) == "p":
            inside: dict[str, list[ET.Element]] = {}
            for x in e.iter():
                inside.setdefault(local(x.tag), []).append(x)
            first = lambda tag, name, other: attr(inside[tag][0], name) if tag in inside else other
            style, num, deep = first("pStyle", "val", None), first("numId", "val", None), first("ilvl", "val", "0")
            link = links.get(first("hyperlink", "id", None), (None,))[0]
            t, level = text(e).strip(), levels.get(style)
            formulas = [omml_to_latex(x).strip() for x in inside.get("oMath", [])]
            if formulas and not t.replace("".join("".join(x.itertext()) for x in inside.get("oMath", [])), "").strip():
                yield 0, "", "equation", None, " ".join(formulas), None, None, None
                continue
            if "blip" in inside:
                yield 0, "", "image", None, "", None, None, None
            if not t:
                continue
            if level is not None:
                yield 0, "", "doc_title" if level == 0 else "paragraph_title", level or 1, t, None, None, None
            elif num and num != "0":
                yield 0, "", "list_item", int(deep or 0) + 1, t, None, link, ordered.get(num, False)
            else:
                yield 0, "", "text", None, t, None, link, None


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[int, str, dict[tuple[int, int], str], list[tuple[int, int, int, int]]]]:
    """(index, name, cells by (row, col), merged ranges) of each visible sheet of an XLSX file; numbers as their formats show them."""
    p = Package(data)
    shared = []
    if (root := p.xml("xl/sharedStrings.xml")) is not None:
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in root]
    rels = p.relations("xl/workbook.xml")
    book = p.xml("xl/workbook.xml")
    codes, own = [], {}
    if (styles := p.xml("xl/styles.xml")) is not None:
        for e in styles.iter():
            if local(e.tag) == "numFmt":
                own[int(e.get("numFmtId", 0))] = e.get("formatCode", "General")
        for xf in (x for e in styles if local(e.tag) == "cellXfs" for x in e):
            n = int(xf.get("numFmtId", 0))
            codes.append(own.get(n, BUILTIN.get(n, "General")))
    since_1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    for k, s in enumerate(x for x in book.iter() if local(x.tag) == "sheet"):
        if s.get("state") in ("hidden", "veryHidden"):
            continue
        root = p.xml(rels[attr(s, "id")][0])
        cells, merged = {}, []
        for e in root.iter():
            if local(e.tag) == "c" and (m := re.fullmatch(r"([A-Z]+)(\d+)", e.get("r", ""))):
                v = next((x.text for x in e if local(x.tag) == "v"), None)
                kind = e.get("t")
                if kind == "s" and v is not None:
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in e.iter() if local(t.tag) == "t")
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                elif kind in (None, "n") and v and (code := codes[int(e.get("s", 0))] if int(e.get("s", 0)) < len(codes) else "General") != "General":
                    v = format_value(float(v), code, since_1904)
                if v:
                    cells[int(m[2]) - 1, column_number(m[1])] = v
            elif local(e.tag) == "mergeCell" and (m := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", e.get("ref", ""))):
                merged.append((int(m[2]) - 1, column_number(m[1]), int(m[4]) - 1, column_number(m[3])))
        yield k, s.get("name", ""), cells, merged


def grid_rows(cells: dict[tuple[int, int], str], merged: list[tuple[int, int, int, int]]) -> list[list[tuple[str, str, int, int]]]:
    """Rows of (tag, text, rowspan, colspan) of the bounds of all cells; covered slots are left out, row 0 is the head."""
    if not cells:
        return []
    top, left = min(r for r, _ in cells), min(c for _, c in cells)
    bottom, right = max(r for r, _ in cells), max(c for _, c in cells)
    heads = {(a, b): (c - a + 1, d - b + 1) for a, b, c, d in merged}
    covered = {(r, c) for a, b, x, y in merged for r in range(a, x + 1) for c in range(b, y + 1)} - heads.keys()
    return [[("th" if r == top else "td", cells.get((r, c), ""), *heads.get((r, c), (1, 1))) for c in range(left, right + 1) if (r, c) not in covered] for r in range(top, bottom + 1)]


def xlsx(data: bytes) -> Iterator[Block]:
    for k, name, cells, merged in sheets(data):
        rows = grid_rows(cells, merged)
        if rows:
            yield k, name, "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None


def pptx(data: bytes) -> Iterator[Block]:
    """Slides in order: title shapes, paragraphs, tables, notes; shapes from top to bottom, then left to right."""
    p = Package(data)
    rels = p.relations("ppt/presentation.xml")
    for k, s in enumerate(x for x in p.xml("ppt/presentation.xml").iter() if local(x.tag) == "sldId"):
        part = rels[next(v for a, v in s.attrib.items() if local(a) == "id" and "relationships" in a)][0]
        shapes = []
        for n, sp in enumerate(x for x in p.xml(part).iter() if local(x.tag) in ("sp", "graphicFrame")):
            off = next((x for x in sp.iter() if local(x.tag) == "off"), None)
            at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (1 << 40, 0)
            kind = next((x.get("type", "") for x in sp.iter() if local(x.tag) == "ph"), "")
            shapes.append((kind not in ("title", "ctrTitle"), at, n, kind, sp))
        for _, _, _, kind, sp in sorted(shapes, key=lambda x: x[:3]):
            if any(local(x.tag) == "tbl" for x in sp.iter()):
                rows = [[("td", "".join(t.text or "" for t in tc.iter() if local(t.tag) == "t"), int(tc.get("rowSpan", 1)), int(tc.get("gridSpan", 1))) for tc in tr if local(tc.tag) == "tc" and not tc.get("hMerge") and not tc.get("vMerge")] for tr in sp.iter() if local(tr.tag) == "tr"]
                yield k, "", "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None
                continue
            for para in (x for x in sp.iter() if local(x.tag) == "p"):
                t = "".join(x.text or "" for x in para.iter() if local(x.tag) == "t").strip()
                if t:
                    title = kind in ("title", "ctrTitle")
                    lvl = next((x.get("lvl") for x in para if local(x.tag) == "pPr"), None)
                    yield k, "", "paragraph_title" if title else "list_item" if lvl else "text", 2 if title else int(lvl) + 1 if lvl else None, t, None, None, False if lvl and not title else None
        note = next((t for t, kind in p.relations(part).values() if kind.endswith("/notesSlide")), None)
        if note and (root := p.xml(note)) is not None:
            for para in (x for x in root.iter() if local(x.tag) == "p"):
                t = "".join(x.text or "" for x in para.iter() if local(x.tag) == "t").strip()
                if t and not t.isdigit():
                    yield k, "", "page_footnote", None, t, None, None, None


def odf_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for x in e:
        t = local(x.tag)
        out.append(" " * int(attr(x, "c") or 1) if t == "s" else "\t" if t == "tab" else "\n" if t == "line-break" else "" if t in ("note", "annotation") else odf_text(x))
        out.append(x.tail or "")
    return "".join(out)


def odf_table(e: ET.Element) -> list[list[tuple[str, str, int, int]]]:
    """Rows of a table element: repeated rows and cells are written out unless they are blank to the end."""
    rows = []
    for tr in (x for x in e.iter() if local(x.tag) == "table-row"):
        row = []
        for tc in tr:
            if local(tc.tag) not in ("table-cell", "covered-table-cell"):
                continue
            t = "\n".join(filter(None, (odf_text(q).strip() for q in tc if local(q.tag) in ("p", "h"))))
            cell = (None if local(tc.tag).startswith("covered") else "td", t, int(attr(tc, "number-rows-spanned") or 1), int(attr(tc, "number-columns-spanned") or 1))
            row += [cell] * min(int(attr(tc, "number-columns-repeated") or 1), 1024 if t else 64)
        while row and not row[-1][1] and row[-1][0] and row[-1][2:] == (1, 1):
            row.pop()
        rows += [row] * (min(int(attr(tr, "number-rows-repeated") or 1), 4096) if row else 1)
    while rows and not rows[-1]:
        rows.pop()
    return [[c for c in r if c[0]] for r in rows]


def odf(data: bytes) -> Iterator[Block]:
    """ODT paragraphs, headings, lists and tables; ODS sheets; ODP pages."""
    root = Package(data).xml("content.xml")
    body = next((e for e in root.iter() if local(e.tag) == "body"), None)
    if body is None or not len(body):
        return

    def walk(e: ET.Element, page: int, name: str, depth: int) -> Iterator[Block]:
        for x in e:
            t = local(x.tag)
            if t == "h":
                if s := odf_text(x).strip():
                    yield page, name, "paragraph_title", int(attr(x, "outline-level") or 1), s, None, None, None
            elif t == "p":
                if s := odf_text(x).strip():
                    link = next((attr(a, "href") for a in x.iter() if local(a.tag) == "a"), None)
                    yield page, name, "list_item" if depth else "text", depth or None, s, None, link, False if depth else None
            elif t == "list":
                for item in x:
                    yield from walk(item, page, name, depth + 1)
            elif t == "table":
                rows = odf_table(x)
                if rows:
                    yield page, attr(x, "name") if local(e.tag) == "spreadsheet" else name, "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None
            elif t in ("section", "frame", "text-box", "custom-shape", "index-body", "table-of-content"):
                yield from walk(x, page, name, depth)

    main = body[0]
    pages = [x for x in main if local(x.tag) == "page"]
    if pages:
        for k, page in enumerate(pages):
            yield from walk(page, k, attr(page, "name") or "", 0)
    elif local(main.tag) == "spreadsheet":
        for k, table in enumerate(x for x in main if local(x.tag) == "table"):
            rows = odf_table(table)
            if rows:
                yield k, attr(table, "name") or "", "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None
    else:
        yield from walk(main, 0, "", 0)


def epub(data: bytes) -> Iterator[Block]:
    """The spine's documents, one page each."""
    p = Package(data)
    opf = next(attr(e, "full-path") for e in p.xml("META-INF/container.xml").iter() if local(e.tag) == "rootfile")
    root = p.xml(opf)
    items = {e.get("id"): e for e in root.iter() if local(e.tag) == "item"}
    for k, ref in enumerate(e for e in root.iter() if local(e.tag) == "itemref"):
        item = items.get(ref.get("idref"))
        name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href", ""))) if item is not None else ""
        if name in p.names:
            for _, kind, level, text, html, href, ordered in html_blocks(p.zip.read(name).decode("utf-8", "replace")):
                yield k, name, kind, level, text, html, href, ordered


def mhtml(data: bytes) -> Iterator[Block]:
    """The root HTML part of a MIME archive."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    part = next((x for x in m.walk() if x.get_content_type() in ("text/html", "application/xhtml+xml")), None)
    if part is not None:
        for _, *b in html_blocks(part.get_content(), part.get("Content-Location")):
            yield 0, "", *b


_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-z]+)(-?\d+)? ?|\\([^a-z'])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
# Destinations of RTF that hold no body text.
RTF_SKIPPED = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr generator listtable listoverridetable themedata datastore xmlnstbl fldinst object".split())


def rtf(data: bytes) -> Iterator[Block]:
    """Paragraphs, outline levels, list items and table rows of a rich-text file."""
    codec = f"cp{m[1].decode()}" if (m := re.search(rb"\\ansicpg(\d+)", data)) else "cp1252"
    stack, skip, skip_unicode, uc = [], False, 0, 1
    text, level, listed, cells, rows = [], None, False, [], []

    def flush() -> Iterator[Block]:
        nonlocal text
        t = "".join(text).strip()
        text = []
        if t:
            kind = "paragraph_title" if level is not None else "list_item" if listed else "text"
            yield 0, "", kind, level + 1 if level is not None else 1 if listed else None, t, None, None, False if kind == "list_item" else None

    def close_table() -> Iterator[Block]:
        nonlocal rows
        if rows:
            grid, rows = [[("td", c, 1, 1) for c in r] for r in rows], []
            yield 0, "", "table", None, "\n".join("\t".join(c[1] for c in r) for r in grid), table_html(grid), None, None

    for m in _RTF.finditer(data):
        hexa, word, number, symbol, brace, plain = m.groups()
        if brace == b"{":
            stack.append((skip, uc))
        elif brace == b"}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif word:
            w, n = word.decode(), int(number) if number else None
            if w in RTF_SKIPPED:
                skip = True
            elif skip:
                continue
            elif w == "u" and n is not None:
                text.append(chr(n % 65536))
                skip_unicode = uc
            elif w == "uc":
                uc = n or 0
            elif w == "par":
                if not cells:
                    yield from close_table()
                yield from flush()
            elif w == "pard":
                level, listed = None, False
            elif w == "outlinelevel":
                level = n
            elif w in ("ls", "pntext", "listtext"):
                listed = True
                skip = skip or w != "ls"
            elif w == "cell":
                cells.append("".join(text).strip())
                text = []
            elif w == "row":
                rows.append(cells)
                cells = []
            elif w in ("tab", "line"):
                text.append("\t" if w == "tab" else "\n")
            elif w in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                text.append({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[w])
        elif symbol == b"*":
            skip = True
        elif skip:
            continue
        elif hexa:
            if skip_unicode:
                skip_unicode -= 1
            else:
                text.append(bytes([int(hexa, 16)]).decode(codec, "replace"))
        elif symbol:
            text.append({b"~": "\u00a0", b"_": "\u2011", b"-": ""}.get(symbol, symbol.decode("latin-1")))
        elif plain:
            t = plain.decode(codec, "replace")
            text.append(t[skip_unicode:])
            skip_unicode = 0
    yield from close_table()
    yield from flush()


def html(data: bytes) -> Iterator[Block]:
    m = re.search(rb"(?i)charset=[\"']?([a-z0-9_-]+)", data[:4096])
    try:
        page = data.decode(m[1].decode() if m else "utf-8")
    except (UnicodeDecodeError, LookupError):
        page = data.decode("cp1252", "replace")
    for _, *b in html_blocks(page):
        yield 0, "", *b


def delimited(data: bytes, delimiter: str | None = None) -> Iterator[Block]:
    rows = records(data, delimiter)
    width = max(map(len, rows), default=0)
    grid = [[("td", v, 1, 1) for v in r + [""] * (width - len(r))] for r in rows]
    if grid:
        yield 0, "", "table", None, "\n".join("\t".join(c[1] for c in r) for r in grid), table_html(grid), None, None


def _as_table(page: int, name: str, rows: list[list[tuple[str, str, int, int]]]) -> Block:
    return page, name, "table", None, "\n".join("\t".join(c[1] for c in r) for r in rows), table_html(rows), None, None


def old_doc(data: bytes) -> Iterator[Block]:
    for kind, body in compound.doc(data):
        yield (0, "", "text", None, body, None, None, None) if kind == "text" else _as_table(0, "", [[("td", c, 1, 1) for c in r] for r in body])


def old_xls(data: bytes) -> Iterator[Block]:
    for k, name, cells, merged in compound.xls(data):
        if rows := grid_rows(cells, merged):
            yield _as_table(k, name, rows)


def old_ppt(data: bytes) -> Iterator[Block]:
    for slide, title, text in compound.ppt(data):
        yield slide, "", "paragraph_title" if title else "text", 2 if title else None, text, None, None, None


def placed(data: bytes, of) -> Iterator[Block]:
    """Blocks of a file of placed characters."""
    for page, kind, level, text in of(data):
        yield page, "", kind, level, text, None, None, None


def ofd(data: bytes) -> Iterator[Block]:
    from foliant.sources.fixed_layout import ofd_blocks  # reads packages itself

    yield from placed(data, ofd_blocks)


READERS = {"pdf": lambda d: placed(d, pdf.blocks), "ofd": ofd, "doc": old_doc, "xls": old_xls, "ppt": old_ppt, "docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odf, "ods": odf, "odp": odf, "epub": epub, "mhtml": mhtml, "rtf": rtf, "html": html, "csv": delimited, "tsv": lambda d: delimited(d, "\t")}


def parse(data: bytes, path: str = "") -> list[tuple]:
    """Rows of ``SCHEMA`` for one file; a file that can't be read is one row with its error."""
    suffix = suffix_of(data, path)
    reader = READERS.get(suffix)
    if reader is None:
        return [(path, suffix, 0, "", 0, None, None, None, None, None, None, f"no reader for {suffix}")]
    try:
        return [(path, suffix, page, name, k, *rest, None) for k, (page, name, *rest) in enumerate(reader(data))]
    except (ValueError, TypeError, csv.Error, struct.error, zlib.error, KeyError, IndexError, StopIteration, RuntimeError, AttributeError, zipfile.BadZipFile, ET.ParseError) as e:
        return [(path, suffix, 0, "", 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


def read_documents(files: DataFrame) -> DataFrame:
    """Block rows (``SCHEMA``) of files (path, content): one file is parsed in one place, any number in parallel."""
    arrow = arrow_schema(SCHEMA)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, data in zip(*batch.columns):
                yield from parse(data.as_py(), path.as_py())

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(lambda batches: batched_rows(rows(batches), arrow), SCHEMA)
