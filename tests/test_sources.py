import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.plans import render
from foliant.sources import delimited, markup, packages
from foliant.sources.detect import signature, suffix_of
from foliant.streaming import ingest


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'
DOCX = pack({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>'
    '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
})
XLSX = pack({
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="x"/><sheet name="H" state="hidden" r:id="y"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<R><r Id="x" Target="worksheets/s.xml"/><r Id="y" Target="worksheets/h.xml"/></R>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>q</t></is></c></row><row><c r="B3"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="B3:C3"/></mergeCells></worksheet>',
    "xl/worksheets/h.xml": "<worksheet/>",
})
PPTX = pack({
    "ppt/presentation.xml": '<p xmlns:r="http://relationships"><sldIdLst><sldId id="256" r:id="a"/></sldIdLst></p>',
    "ppt/_rels/presentation.xml.rels": '<R><r Id="a" Target="slides/s1.xml"/></R>',
    "ppt/slides/s1.xml": '<s xmlns:a="http://a"><sp><a:off x="5" y="9"/><a:p><a:r><a:t>Body</a:t></a:r></a:p></sp><sp><ph type="title"/><a:off x="5" y="99"/><a:p><a:r><a:t>Top</a:t></a:r></a:p></sp></s>',
})
ODT = pack({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": '<d xmlns:o="http://o" xmlns:t="http://t"><o:body><o:text><t:h t:outline-level="2">H</t:h><t:p>a<t:s t:c="2"/>b</t:p><t:list><t:list-item><t:p>i</t:p></t:list-item></t:list></o:text></o:body></d>'})
ODS = pack({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": '<d xmlns:o="http://o" xmlns:t="http://t"><o:body><o:spreadsheet><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="2"><t:p>x</t:p></t:table-cell><t:table-cell t:number-columns-repeated="1000"/></t:table-row></t:table></o:spreadsheet></o:body></d>'})
RTF = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}\pard\outlinelevel0 Head\par\pard Caf\'e9 " + b"\\u" + rb"8364?x\par a\cell b\cell\row\pard\par}"
MHT = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=B\r\n\r\n--B\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<h1>T</h1><p>x</p>\r\n--B--\r\n"


def seen(data, path=""):
    return [(r[5], r[6], r[7]) for r in packages.parse(data, path)]


def test_office_packages():
    assert seen(DOCX) == [("paragraph_title", 1, "Head"), ("text", None, "One two"), ("list_item", 2, "item"), ("table", None, "a\tb\nc")]
    assert packages.parse(DOCX)[2][10] is True and 'rowspan="2"' in packages.parse(DOCX)[3][8]
    assert [(r[3], r[8]) for r in packages.parse(XLSX)] == [("S", '<table><tr><th>name</th><th>q</th></tr><tr><td colspan="2">7</td></tr></table>')]
    assert seen(PPTX) == [("paragraph_title", 2, "Top"), ("text", None, "Body")]
    assert seen(ODT) == [("paragraph_title", 2, "H"), ("text", None, "a  b"), ("list_item", 1, "i")]
    assert seen(ODS) == [("table", None, "x\tx")]
    assert seen(RTF) == [("paragraph_title", 1, "Head"), ("text", None, "Café €x"), ("table", None, "a\tb")]
    assert seen(MHT) == [("doc_title", 1, "T"), ("text", None, "x")]
    assert seen(b"a;b\n1;2\n", "f.csv") == [("table", None, "a\tb\n1\t2")]


def test_bad_files_are_rows_with_errors():
    for data, path in ((b"PK\x03\x04junk", "a.docx"), (b"%PDF-1.7", "a.pdf"), (pack({"word/document.xml": "<x"}), "b.docx"), (b'a,"b\n', "c.csv")):
        rows = packages.parse(data, path)
        assert len(rows) == 1 and rows[0][-1]


def test_rendered_packages_can_be_read(spark):
    rows = [(1, 0, 0, "doc_title", 1, "A & <B>", None, None, None), (1, 0, 1, "text", None, "x\x01y", None, None, None), (1, 0, 2, "header", None, "gone", None, None, None)]
    b = spark.createDataFrame(rows, "k int, page_idx int, idx int, type string, level int, text string, html string, href string, ordered boolean")
    docx = bytes(render.to_package(b, "k", "docx").first().content)
    assert seen(docx) == [("paragraph_title", 1, "A & <B>"), ("text", None, "x�y")]
    epub = bytes(render.to_package(b.where("idx <> 1"), "k", "epub").first().content)
    assert suffix_of(epub) == "epub" and seen(epub) == [("doc_title", 1, "A & <B>")]
    assert render.to_markdown(b, "k").first().markdown.startswith("# A & <B>\n\nx")
    assert "gone" in render.to_markdown(b, "k", full=True).first().markdown
    assert "\\section{A \\& <B>}" in render.to_latex(b, "k").first().latex and "&lt;B&gt;" in render.to_html(b, "k").first().html
    assert '"page_idx":0' in render.to_structured(b, "k").first().json


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "yy")], "name string, content string")
    m = render.write_bundle(df, f"{tmp_path}/b", "name", "content")
    assert {(r.name, r.size) for r in m.collect()} == {("a", 1), ("b", 2)}
    assert {bytes(r.content) for r in render.load_bundle(spark, f"{tmp_path}/b").collect()} == {b"x", b"yy"}
    with pytest.raises(Exception):
        render.write_bundle(df, f"{tmp_path}/b", "name", "content")
    spark.read.parquet(f"{tmp_path}/b").withColumn("sha256", F.lit("0")).write.parquet(f"{tmp_path}/c")
    with pytest.raises(Exception):
        render.load_bundle(spark, f"{tmp_path}/c").collect()


def test_html_blocks():
    page = "<html><body><h1>T</h1><p>a <b>b</b><p>c<ul><li>x<ol><li>y</ol></ul><table><tr><th>h<td colspan=2>d</table><pre>k\n  l</pre><blockquote>q</blockquote><img src='i.png' alt='pic'><nav>n</nav><script>no</script></body>"
    got = [(b[1], b[2], b[3]) for b in markup.html_blocks(page, "http://h/p/")]
    assert got == [("doc_title", 1, "T"), ("text", None, "a b"), ("text", None, "c"), ("list_item", 1, "x"), ("list_item", 2, "y"), ("table", None, "h\td"), ("code", None, "k\n  l"), ("quote", None, "q"), ("image", None, "pic"), ("index", None, "n")]
    assert markup.html_blocks(page, "http://h/p/")[8][5] == "http://h/p/i.png"
    assert markup.html_blocks(None) == [] and markup.html_blocks("<table>") == []


def test_delimited():
    assert delimited.sniff("a;b;c\n1;2,5;3\n")[0] == ";" and delimited.sniff("sep=|\na|b")[0] == "|" and delimited.sniff("x\ny")[0] == ","
    assert delimited.records('﻿a,"b ""q"""\n'.encode()) == [["a", 'b "q"']]
    assert delimited.decode("é".encode("utf-16")) == "é" and delimited.decode("naïve café".encode("cp1252")) == "naïve café"
    with pytest.raises(ValueError):
        delimited.decode(b"\xff\xfe\x00\x00a")


def test_signatures(spark):
    data = [bytearray(b) for b in (b"%PDF-1", b"{\\rtf1", DOCX, bytes.fromhex("D0CF11E0A1B11AE1"), MHT, b" <!DOCTYPE html><p>", b"plain")]
    got = [r.s for r in spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, c binary").orderBy("i").select(signature(F.col("c")).alias("s")).collect()]
    assert got == ["pdf", "rtf", "zip", "ole", "mhtml", "html", "text"]
    assert [suffix_of(d) for d in (DOCX, XLSX, PPTX, ODT, ODS)] == ["docx", "xlsx", "pptx", "odt", "ods"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_bytes(b"<html><h1>T</h1><p>x</p></html>")
    ingest.write_once(ingest.stream_blocks(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    (tmp_path / "in/b.csv").write_bytes(b"a,b\n1,2\n")
    ingest.write_once(ingest.stream_blocks(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.suffix, r.type) for r in got.collect()} == {("html", "doc_title"), ("html", "text"), ("csv", "table")} and got.count() == 3


def test_streaming_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:05:00", 1, "view", 1.0), (2, "2024-01-01 00:20:00", 1, "view", 2.0), (3, "2024-01-01 09:00:00", 1, "view", 4.0), (4, "2024-01-02 09:00:00", 1, "view", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/ev")
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/k").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("tumbled").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]


def test_data_source(spark, tmp_path):
    from foliant.sources.datasource import register

    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.docx").write_bytes(DOCX)
    (tmp_path / "b.csv").write_bytes(b"a,b\n1,2\n")
    register(spark)
    got = spark.read.format("foliant_documents").option("filesPerPartition", 1).load(str(tmp_path))
    assert {(r.suffix, r.type) for r in got.collect()} == {("docx", "paragraph_title"), ("docx", "text"), ("docx", "list_item"), ("docx", "table"), ("csv", "table")}
    assert spark.read.format("foliant_documents").option("suffixes", "csv").load(str(tmp_path)).count() == 1
