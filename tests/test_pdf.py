"""PDF files written here, read back: places, text, fonts, forms, rotation, structure, broken files."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.plans.pdf_writer import EM, flowed, pdf_of, to_pdf
from foliant.sources import pdf
from foliant.sources.packages import parse, read_documents


def body(objects, start=b"%PDF-1.4\n", trailer=b"trailer << /Root 1 0 R >>\n"):
    """Objects in the open, without a table: found by their heads."""
    return start + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items()) + trailer


def stream(data, head=b""):
    return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), head, data)


def page(content, resources=b"<< /Font << /F 9 0 R >> >>", more=b"", extra=None):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R %s>>" % more, 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources %s >>" % resources, 4: stream(content)}
    objects[9] = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 65 /Widths [600 300 1000] /Encoding << /Differences [67 /eacute /uni6F22] >> >>"
    return body(objects | (extra or {}))


def chars(data):
    return [(r[3], round(r[4], 3), round(r[5], 3), round(r[6], 3), round(r[7], 3)) for r in pdf.marks(data) if r[2] == "char"]


@pytest.mark.parametrize("packed", [True, False])
def test_placed_text_comes_back(packed):
    rng = random.Random(1)
    pages = []
    for _ in range(3):
        marks = [("text", rng.randint(10, 400), rng.randint(20, 800), rng.choice([8, 10.5, 16]), rng.random() < 0.5, rng.choice(["plain (text)\\", "Üñï – “q”", "漢字 кир", "a"])) for _ in range(12)]
        pages.append([*marks, ("rule", 10, 20, 110, 20), ("rect", 30, 40, 80, 90), ("link", 5, 6, 50, 16, "https://example.org/x")])
    data = pdf_of(pages, "A title – 漢", packed=packed)
    assert data == pdf_of(pages, "A title – 漢", packed=packed)
    rows = list(pdf.marks(data))
    for k, marks in enumerate(pages):
        want = [(c, x + i * EM * size, x + (i + 1) * EM * size, base, size, bold) for _, x, base, size, bold, text in marks[:12] for i, c in enumerate(text)]
        got = [r for r in rows if r[0] == k and r[2] == "char"]
        assert [r[3] for r in got] == [w[0] for w in want]
        for r, (_, x0, x1, base, size, bold) in zip(got, want):
            assert (r[4], r[6], r[7] - 0.2 * size, r[8]) == pytest.approx((x0, x1, base, size), abs=0.01)
            assert bold or not r[10]
        assert [tuple(round(v) for v in r[4:8]) for r in rows if r[0] == k and r[2] == "rule"] == [(10, 20, 110, 20)]
        assert [tuple(round(v) for v in r[4:8]) for r in rows if r[0] == k and r[2] == "rect"] == [(30, 40, 80, 90)]
        assert [(r[3], tuple(round(v) for v in r[4:8])) for r in rows if r[0] == k and r[2] == "link"] == [("https://example.org/x", (5, 6, 50, 16))]
    assert [r[13:15] for r in rows if r[2] == "page"] == [(595.0, 842.0)] * 3
    assert pdf.metadata(pdf.Document(data)) == {"Title": "A title – 漢"}
    assert [r[0] for r in pdf.marks(data, {1}) if r[2] == "page"] == [1]


def test_widths_encodings_and_text_operators():
    got = chars(page(b"BT /F 10 Tf 20 50 Td (AB) Tj 0 -12 TD [(A) -500 (C)] TJ T* 2 Tc 50 Tz (AA) Tj (D) ' ET"))
    assert got[0] == ("A", 20, 42, 26, 52) and (got[1][1], got[1][3]) == (26, 29)
    assert [g[0] for g in got] == list("ABAéAA漢")
    assert got[3][1] == 20 + 6 + 5 and (got[4][1], got[4][3]) == (20, 23) and got[5][1] == 24
    assert got[6][3] - got[6][1] == 2.5  # an unknown width is half an em


def test_matrices_forms_and_rotation():
    form = stream(b"BT /F 10 Tf (A) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /BBox [0 0 50 50] ")
    data = page(b"q 2 0 0 2 10 20 cm /X Do Q 0 0 100 1 re f", b"<< /Font << /F 9 0 R >> /XObject << /X 8 0 R >> >>", extra={8: form})
    (c,) = chars(data)
    assert c == ("A", 20, 54, 32, 74)
    assert [r[2] for r in pdf.marks(data)] == ["page", "char", "rule"]
    turned = data.replace(b"/MediaBox [0 0 200 100]", b"/MediaBox [0 0 200 100] /Rotate 90")
    rows = list(pdf.marks(turned))
    assert rows[0][13:15] == (100, 200) and [round(v) for v in rows[1][4:8]] == [100 - 74, 20, 100 - 54, 32]


def test_two_byte_fonts_and_unicode_maps():
    cmap = stream(b"2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <4E00> endbfrange 1 beginbfrange <0020> <0021> [<0058> <0059>] endbfrange")
    extra = {9: b"<< /Subtype /Type0 /BaseFont /ABCDEF+Name-Bold /Encoding /Identity-H /DescendantFonts [10 0 R] /ToUnicode 11 0 R >>", 10: b"<< /Subtype /CIDFontType2 /DW 500 /W [1 [600 800] 16 18 1000] >>", 11: cmap}
    got = chars(page(b"BT /F 10 Tf 0 50 Td <00010002001000110021> Tj ET", extra=extra))
    assert [g[0] for g in got] == ["A", "f", "i", "一", "丁", "Y"]
    assert [round(g[3] - g[1], 3) for g in got] == [6, 4, 4, 10, 10, 5]
    assert [r[9:11] for r in pdf.marks(page(b"BT /F 10 Tf <0001> Tj ET", extra=extra)) if r[2] == "char"] == [("Name-Bold", True)]


def test_filters():
    plain = bytes(range(256)) * 3
    rows = bytearray()
    above = bytes(16)
    for k in range(0, len(plain), 16):
        row = plain[k : k + 16]
        rows += bytes([2]) + bytes((a - b) & 255 for a, b in zip(row, above))
        above = row
    doc = pdf.Document(body({1: b"<< /Type /Catalog >>"}))
    cases = [
        ({"Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 16}}, zlib.compress(bytes(rows))), ({"Filter": [pdf.Name("ASCIIHexDecode"), pdf.Name("FlateDecode")]}, zlib.compress(plain).hex().encode() + b">"),
        ({"Filter": pdf.Name("RunLengthDecode")}, b"".join(bytes([127]) + plain[k : k + 128] for k in range(0, len(plain), 128)) + b"\x80"), ({}, plain),
    ]
    for head, raw in cases:
        assert doc.decoded(pdf.Stream(head, raw)) == plain
    assert doc.decoded(pdf.Stream({"Filter": pdf.Name("LZWDecode")}, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_structure_tree_and_marked_content():
    extra = {5: b"<< /Type /StructTreeRoot /K 6 0 R /RoleMap << /Titel /H1 >> >>", 6: b"<< /S /Document /K [7 0 R << /S /P /Pg 3 0 R /K [1 2] >>] >>", 7: b"<< /S /Titel /T (One) /Pg 3 0 R /K 0 /P 6 0 R >>"}
    data = page(b"/H1 << /MCID 0 >> BDC BT /F 10 Tf (A) Tj ET EMC /P << /MCID 1 >> BDC BT /F 10 Tf (B) Tj ET EMC BT /F 10 Tf (C) Tj ET", more=b"/StructTreeRoot 5 0 R ", extra=extra)
    assert [r[12] for r in pdf.marks(data) if r[2] == "char"] == [0, 1, None]
    assert list(pdf.structure(pdf.Document(data))) == [(0, -1, "Document", "", -1, -1), (1, 0, "H1", "One", 0, -1), (2, 1, "", "", 0, 0), (3, 0, "P", "", 0, -1), (4, 3, "", "", 0, 1), (5, 3, "", "", 0, 2)]


def test_broken_files_are_rows_with_errors(spark):
    good = pdf_of([[("text", 50, 100, 12, False, "Still here")]])
    cut = good[: good.rfind(b"startxref")]  # no table: scanned
    assert "".join(c[0] for c in chars(cut)) == "Still here"
    loop = body({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R] >>"})
    with pytest.raises(pdf.PdfError):
        list(pdf.marks(loop))
    nested = page(b"[" * 5000)
    files = [("good", good), ("none", b"%PDF-1.4 nothing"), ("text", b"hello"), ("nested", nested), ("locked", body({1: b"<< /Type /Catalog >>"}, trailer=b"trailer << /Root 1 0 R /Encrypt 5 0 R >>"))]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in files], "path string, content binary")
    got = pdf.read_marks(df).collect()
    errors = {r.path: r.error for r in got if r.error}
    assert set(errors) == {"none", "text", "nested", "locked"} and "encrypted" in errors["locked"]
    assert pdf.read_structure(df).count() == 0
    rng = random.Random(3)
    for _ in range(200):  # no input may raise anything else
        bad = bytearray(good)
        for _ in range(rng.randint(1, 30)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            list(pdf.marks(bytes(bad)))
        except pdf.FAILURES:
            pass


def test_documents_are_written_and_read_as_blocks(spark):
    rows = [("d", 0, k, kind, level, text, None) for k, (kind, level, text) in enumerate([("doc_title", 1, "The Title"), ("text", None, "Some words of a first paragraph. " * 12), ("paragraph_title", 2, "Part one"), ("text", None, "Second paragraph."), ("list_item", 1, "an item")])]
    df = spark.createDataFrame(rows, "doc string, page_idx int, idx int, type string, level int, text string, href string")
    files = to_pdf(df, "doc").select(F.concat("doc", F.lit(".pdf")).alias("path"), "content")
    got = [(r.type, r.text) for r in sorted(read_documents(files).collect(), key=lambda r: r.idx)]
    assert got == [("paragraph_title", "The Title"), ("text", ("Some words of a first paragraph. " * 12).strip()), ("paragraph_title", "Part one"), ("text", "Second paragraph."), ("text", "• an item")]
    many = flowed([("text", None, f"Paragraph {k} " * 30, None) for k in range(40)])
    assert len(many) > 2 and all(m[2] < 842 - 50 for p in many for m in p)
    assert parse(b"%PDF-1.7 broken", "x.pdf")[0][-1]
