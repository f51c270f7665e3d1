"""PDF output: pages of placed text, rules, rectangles and links, and documents flowed from blocks."""

from __future__ import annotations

import textwrap
import zlib
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.render import planned
from foliant.plans.shared import by_group

#: Points of a page and of its margins; ems of a character of the fixed-pitch fonts.
WIDTH, HEIGHT, MARGIN, EM = 595.0, 842.0, 56.0, 0.6
#: Sizes of text, of titles by level, and lines' distance by size.
TEXT, TITLES, LEAD = 10.0, (18.0, 15.0, 13.0, 12.0), 1.4


def _literal(text: str) -> bytes | None:
    """A string of the single-byte font, or None if it lacks a character."""
    try:
        data = text.encode("cp1252")
    except UnicodeEncodeError:
        return None
    return b"(" + data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def _content(marks: list[tuple], height: float) -> bytes:
    out = []
    for kind, *v in marks:
        if kind == "text":
            x, y, size, bold, text = v
            plain = _literal(text)
            wide = "".join(c if ord(c) < 0x10000 else "�" for c in text).encode("utf-16-be").hex().encode()
            font, shown = (b"F2" if bold else b"F1", plain) if plain is not None else (b"F3", b"<" + wide + b">")
            out.append(b"BT /%s %g Tf 1 0 0 1 %g %g Tm %s Tj ET" % (font, size, x, height - y, shown))
        elif kind == "rule":
            out.append(b"0.5 w %g %g m %g %g l S" % (v[0], height - v[1], v[2], height - v[3]))
        elif kind == "rect":
            out.append(b"%g %g %g %g re f" % (v[0], height - v[3], v[2] - v[0], v[3] - v[1]))
    return b"\n".join(out)


def pdf_of(pages: list[list[tuple]], title: str = "", width: float = WIDTH, height: float = HEIGHT, packed: bool = True) -> bytes:
    """A file of pages of marks: ("text", x, base line, size, bold, text), ("rule" or "rect", x0, y0, x1, y1), ("link", x0, y0, x1, y1, uri).

    Places are points from the top left. Text is set in a fixed-pitch font;
    what its code page lacks in a two-byte one with a map to Unicode. Equal
    pages give equal bytes. ``packed``: objects in a compressed stream with a
    cross-reference stream, else in the open with a table.
    """
    descriptor = b"/Type /FontDescriptor /FontName /Courier /Flags 5 /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 600 /StemV 80 /FontBBox [0 -200 600 800]"
    objects: list[bytes] = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (9 + 2 * k) for k in range(len(pages))), len(pages)),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier-Bold /Encoding /WinAnsiEncoding >>",
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Courier /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Courier /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 600 /FontDescriptor << %s >> >>" % descriptor,
        _to_unicode(),
        b"<< /Title %s >>" % (b"<feff" + title.encode("utf-16-be", "replace").hex().encode() + b">"),
    ]
    for k, marks in enumerate(pages):
        links = b" ".join(
            b"<< /Type /Annot /Subtype /Link /Rect [%g %g %g %g] /Border [0 0 0] /A << /S /URI /URI %s >> >>" % (v[0], height - v[3], v[2], height - v[1], _literal(v[4]) or b"()") for kind, *v in marks if kind == "link"
        )
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> /Contents %d 0 R%s >>" % (width, height, 10 + 2 * k, b" /Annots [" + links + b"]" if links else b""))
        objects.append(_stream(_content(marks, height)))
    return (_packed if packed else _open)(objects)


@cache
def _to_unicode() -> bytes:
    return _stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"100 beginbfrange\n" + b"\n".join(b"<%02x00> <%02xff> <%02x00>" % (k, k, k) for k in range(256)) + b"\nendbfrange")


def _stream(data: bytes, head: bytes = b"") -> bytes:
    body = zlib.compress(data, 6)
    return b"<< /Length %d /Filter /FlateDecode %s>>\nstream\n" % (len(body), head) + body + b"\nendstream"


def _open(objects: list[bytes]) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 8 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


def _packed(objects: list[bytes]) -> bytes:
    inside = [k for k, body in enumerate(objects, 1) if b"\nstream\n" not in body]
    heads, bodies, at = [], [], 0
    for k in inside:
        heads.append(b"%d %d" % (k, at))
        bodies.append(objects[k - 1])
        at += len(objects[k - 1]) + 1
    head = b" ".join(heads) + b" "
    pack, table = len(objects) + 1, len(objects) + 2
    out, rows = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {0: (0, 0, 65535)}
    rows |= {k: (2, pack, n) for n, k in enumerate(inside)}
    for k, body in [*((k, b) for k, b in enumerate(objects, 1) if k not in rows), (pack, _stream(head + b"\n".join(bodies), b"/Type /ObjStm /N %d /First %d " % (len(inside), len(head))))]:
        rows[k] = (1, len(out), 0)
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    rows[table] = (1, start, 0)
    data = b"".join(bytes([t]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for t, a, b in (rows[k] for k in range(table + 1)))
    out += b"%d 0 obj\n" % table + _stream(data, b"/Type /XRef /W [1 4 2] /Size %d /Root 1 0 R /Info 8 0 R " % (table + 1)) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def flowed(rows: list[tuple]) -> list[list[tuple]]:
    """Pages of marks from (type, level, text, href) blocks, one under the other; a table is its text's rows between rules."""
    pages: list[list[tuple]] = [[]]
    y = MARGIN
    wide = WIDTH - 2 * MARGIN

    def line(text: str, size: float, bold: bool, indent: float = 0.0) -> None:
        nonlocal y
        if y + size * LEAD > HEIGHT - MARGIN:
            pages.append([])
            y = MARGIN
        y += size * LEAD
        pages[-1].append(("text", MARGIN + indent, y, size, bold, text))

    def rule() -> None:
        nonlocal y
        y += 3
        pages[-1].append(("rule", MARGIN, y, MARGIN + wide, y))

    for kind, level, text, href in rows:
        text = text or ""
        if not text.isprintable():
            text = "".join(c if c in "\n\t" or c.isprintable() else " " for c in text)
        title = kind in ("doc_title", "paragraph_title")
        size = TITLES[min(max(int(level or 2), 1), len(TITLES)) - 1] if title else TEXT
        indent = 12.0 * max(1, int(level or 1)) if kind == "list_item" else 12.0 if kind == "quote" else 0.0
        if kind == "list_item":
            text = f"• {text}"
        y += size * 0.6
        if kind == "table":
            rule()
        first = len(pages[-1])
        for part in text.replace("\t", "  ").split("\n"):
            for piece in textwrap.wrap(part, max(8, int((wide - indent) / (EM * size))), drop_whitespace=True) or [""]:
                line(piece, size, title, indent)
        if kind == "table":
            rule()
        if href and len(pages[-1]) > first:
            _, x, base, s, _, shown = pages[-1][-1]
            pages[-1].append(("link", x, base - s, x + EM * s * len(shown), base + 0.2 * s, href))
    return pages


def to_pdf(blocks: DataFrame, key: str) -> DataFrame:
    """(key, content): each document's blocks as a PDF file; one document is one group."""
    dtype = blocks.schema[key].dataType.simpleString()
    have = set(blocks.columns)
    column = lambda c, other: (F.col(c) if c in have else other).alias(c)

    def run(name, rows: list[tuple]) -> list[tuple]:
        return [(name, pdf_of(flowed([r[3:] for r in rows]), str(name)))]

    none = F.lit(None)
    d = planned(blocks).select(key, F.coalesce(column("page_idx", F.lit(0)), F.lit(0)).alias("page_idx"), "idx", "type", column("level", none.cast("int")), "text", column("href", none.cast("string")))
    return by_group(d, key, [F.asc_nulls_last("page_idx"), F.asc_nulls_last("idx")], run, f"{key} {dtype}, content binary")
