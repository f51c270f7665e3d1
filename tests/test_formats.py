import io
import zipfile
import zlib
from xml.etree import ElementTree as ET

import numpy as np
import pytest

from foliant.functions import images
from foliant.functions.formats import BUILTIN, format_value
from foliant.functions.mathml import mathml_to_latex, omml_to_latex
from foliant.sources.fixed_layout import deltas, lines_of, ofd, pdf, read_chars
from foliant.sources.main_content import select, text_of
from foliant.sources.metadata import properties
from foliant.sources.packages import parse


@pytest.mark.parametrize(
    "value, code, text",
    [
        (1234.5, "#,##0.00", "1,234.50"), (-3.0, "0.0;(0.0)", "(3.0)"), (0.0, "0;-0;zero", "zero"), (0.125, "0.0%", "12.5%"), (12345.0, "0.00E+00", "1.23E+04"), (45292.75, "yyyy-mm-dd h:mm", "2024-01-01 18:00"),
        (0.5, "h:mm AM/PM", "12:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (2.25, "# ?/?", "2 1/4"), (1234567.0, "#,##0,", "1,235"), (5.0, '"x"0', "x5"), (5.0, "[>3]\"big\";0", "big"), (1.0, None, "1"), (1e20, "General", "1E+20".replace("1E", "1.000000000000000E")),
        (60.0, "yyyy-mm-dd", "60"), (61.0, "d-mmm-yy", "1-Mar-00"), (2.5, "0", "3"), (0.5, "mm:ss.0", "00:00.0"), (7.0, "00000", "00007"), (-0.5, "0.00", "-0.50"),
    ],
)
def test_number_formats(value, code, text):
    got = format_value(value, code)
    assert got == text or (code == "General" and float(got) == value)


def test_mathml():
    m = lambda x: mathml_to_latex(f"<math>{x}</math>")
    assert m("<mfrac><mi>a</mi><mn>2</mn></mfrac>") == r"\frac{a}{2}" and m("<msup><mi>x</mi><mn>2</mn></msup>") == "x^{2}" and m("<msqrt><mi>α</mi></msqrt>") == r"\sqrt{\alpha }"
    assert m("<munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover>") == r"\sum_{i}^{n}" and mathml_to_latex("<math>") is None
    assert m("<semantics><mi>x</mi><annotation encoding='application/x-tex'> y </annotation></semantics>") == "y"


def test_office_formulas():
    ns = "xmlns:m='http://m'"
    m = lambda x: omml_to_latex(ET.fromstring(f"<m:oMath {ns}>{x}</m:oMath>")).strip()
    r = lambda t: f"<m:r><m:t>{t}</m:t></m:r>"
    assert m(f"<m:f><m:num>{r('a')}</m:num><m:den>{r('π')}</m:den></m:f>") == r"\frac{a}{\pi}" and m(f"<m:sSup><m:e>{r('x')}</m:e><m:sup>{r('2')}</m:sup></m:sSup>") == "{x}^{2}"
    assert m(f"<m:rad><m:deg/><m:e>{r('y')}</m:e></m:rad>") == r"\sqrt{y}" and m(f"<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub>{r('i')}</m:sub><m:sup>{r('n')}</m:sup><m:e>{r('i')}</m:e></m:nary>") == r"\sum_{i}^{n}{i}"
    w = "xmlns:w='http://w'"
    doc = zipped({"word/document.xml": f"<w:document {w} {ns}><w:body><w:p><m:oMathPara><m:oMath>{r('z')}</m:oMath></m:oMathPara></w:p></w:body></w:document>"})
    assert [(b[5], b[7]) for b in parse(doc)] == [("equation", "z")]


def test_images():
    mask = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1]], np.uint8)
    n, lab, stats = images.labels(mask)
    assert n == 2 and lab[0, 0] == lab[1, 1] == 1 and stats.tolist() == [[0, 0, 2, 2, 2], [3, 1, 1, 2, 2]]
    sq = np.array([[0, 0], [4, 0], [4, 4], [0, 4]])
    assert images.contour_area(sq) == 16 and images.contour_length(sq) == 16 and images.fill_polygon((6, 6), sq).sum() == 255 * 5 * 4
    img = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert images.resize(img, 4, 4).tolist() == img.tolist() and images.resize(img, 2, 2, nearest=True).shape == (2, 2) and images.resize(img, 2, 2)[0, 0] == 3
    assert images.morphology(mask * 255, 3, 3, "dilate")[0, 2] == 255 and images.morphology(mask * 255, 3, 3, "open").sum() == 0
    assert images.gray(np.full((1, 1, 3), 200, np.uint8))[0, 0] == 200 and images.contrast(np.zeros((2, 2), np.uint8)) == 0
    m = images.perspective(sq, sq * 2)
    assert np.allclose(images.transform(sq, m), sq * 2)
    assert len(images.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [2, 2]]), 0.1)) == 3


OFD = {
    "OFD.xml": "<o><DocBody><DocRoot>Doc_0/Document.xml</DocRoot></DocBody></o>", "Doc_0/Document.xml": '<d><Pages><Page BaseLoc="Pages/P.xml"/></Pages></d>',
    "Doc_0/Pages/P.xml": '<p><TextObject Boundary="10 20 50 10" Size="4"><TextCode X="0" Y="4" DeltaX="g 2 4">abc</TextCode></TextObject></p>',
}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def a_pdf():
    s = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello) Tj 0 -20 Td [(W) -10 (orld \\(x\\))] TJ ET")
    return b"%PDF-1.4\n1 0 obj<</Type/Page/MediaBox[0 0 612 792]/Contents 2 0 R>>endobj\n2 0 obj<</Filter/FlateDecode>>stream\n" + s + b"\nendstream endobj\n"


def test_placed_characters(spark):
    assert deltas("g 2 4 1", 3) == [4, 4, 1]
    assert [(c[1], c[2]) for c in ofd(zipped(OFD))] == [("a", 10), ("b", 14), ("c", 18)]
    assert "".join(c[1] for c in pdf(a_pdf())) == "HelloWorld (x)"
    files = spark.createDataFrame([("a.pdf", bytearray(a_pdf())), ("b.ofd", bytearray(zipped(OFD))), ("c.ofd", bytearray(b"PK"))], "path string, content binary")
    lines = lines_of(read_chars(files), ["path", "page_idx"])
    assert sorted((r.path, r.line, r.text) for r in lines.collect()) == [("a.pdf", 0, "Hello"), ("a.pdf", 1, "World (x)"), ("b.ofd", 0, "abc")]


def test_main_content():
    prose = "<p>" + "Words of an article that go on. " * 12 + "</p>"
    menu = "<div class=menu>" + "<a href=x>link</a>" * 30 + "</div>"
    node, how = select(f"<body>{menu}<div id=content>{prose}{prose}</div><div class=sidebar>{menu}</div></body>")
    assert how == "scored" and node.tokens == {"content"} and "link" not in text_of(node)
    assert select(f"<body><article>{prose}</article>{menu}</body>")[1] == "explicit" and select("<p>x")[1] == "page"


def test_metadata():
    html = b"<html lang=fr><head><title> A </title><meta name=author content='X'><meta property='og:title' content='B'></head><body><title>no</title></body>"
    assert properties(html, "a.html")[:6] == ("a.html", "html", "B", ["X"], None, "fr")
    docx = zipped({"word/document.xml": "<d/>", "docProps/core.xml": "<c xmlns:dc='http://d'><dc:title>T</dc:title><dc:creator>Y</dc:creator></c>", "docProps/app.xml": "<a><Pages>3</Pages></a>"})
    assert properties(docx)[2:4] == ("T", ["Y"]) and properties(docx)[8] == 3


RICH = [
    ("paragraph_title", 1, "Top", None, None, None), ("text", None, "See the site", None, "https://example.org/?a=1&b=2", None), ("list_item", 1, "first", None, None, False), ("list_item", 2, "inner", None, None, True),
    ("table", None, "a\tb", '<table><tr><th rowspan="2">a</th><th colspan="2">b</th></tr><tr><td>c</td><td>d &amp; e</td></tr></table>', None, None), ("text", None, "The end.", None, None, None),
]


def test_packages_keep_lists_tables_and_links():
    from foliant.plans.render import docx_bytes, epub_bytes
    from foliant.sources.packages import parse

    for data, name in ((docx_bytes(RICH), "a.docx"), (epub_bytes(RICH, "t"), "a.epub")):
        assert data == (docx_bytes(RICH) if name == "a.docx" else epub_bytes(RICH, "t"))
        got = parse(data, name)
        by = {}
        for r in got:
            by.setdefault(r[5], []).append(r)
        assert [r[7] for k in ("doc_title", "paragraph_title") for r in by.get(k, [])] == ["Top"] and [r[7] for r in by["text"]] == ["See the site", "The end."]
        assert [(r[7], bool(r[10])) for r in by["list_item"]] == [("first", False), ("inner", True)]
        (t,) = by["table"]
        assert 'rowspan="2">a' in t[8] and 'colspan="2">b' in t[8] and "<td>d &amp; e</td>" in t[8]
        assert by["text"][0][9] == "https://example.org/?a=1&b=2"


def test_sheet_numbers_are_shown_by_their_formats():
    from foliant.sources.packages import parse

    ns = "xmlns='http://m' xmlns:r='http://r'"
    data = zipped({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": f"<workbook {ns}><sheets><sheet name='S' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='r1' Type='t' Target='worksheets/s.xml'/></Relationships>",
        "xl/styles.xml": "<styleSheet><numFmts><numFmt numFmtId='170' formatCode='yyyy-mm-dd'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='10'/><xf numFmtId='170'/><xf numFmtId='4'/></cellXfs></styleSheet>",
        "xl/worksheets/s.xml": "<worksheet><sheetData><row><c r='A1'><v>1.5</v></c><c r='B1' s='1'><v>0.125</v></c><c r='C1' s='2'><v>45292</v></c><c r='D1' s='3'><v>1234.5</v></c><c r='E1' s='9'><v>7</v></c></row></sheetData></worksheet>",
    })
    (row,) = parse(data, "a.xlsx")
    assert row[7] == "1.5\t12.50%\t2024-01-01\t1,234.50\t7"


def test_formats_of_odd_numbers_do_not_raise():
    assert format_value(float("inf"), "0.00") == "inf" and format_value(1e9, "yyyy-mm-dd") == "#####" and format_value(1e-6, None) == "1e-06"
    assert BUILTIN[14] == "mm-dd-yy" and BUILTIN[22] == "m/d/yy h:mm" and BUILTIN[40].startswith("#,##0.00;[Red]")
