"""Block rows (key, page_idx, idx, type, level, text, html, href, ordered) as Markdown, HTML, LaTeX, JSON, DOCX and EPUB."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from html.parser import HTMLParser
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.shared import by_group

# Block types that frame a page and aren't part of the text.
FURNITURE = ("header", "footer", "page_number", "page_footnote", "aside_text", "index")


def planned(blocks: DataFrame, full: bool = False) -> DataFrame:
    """What is shown: without page furniture, unless ``full``."""
    return blocks if full else blocks.where(~F.col("type").isin(*FURNITURE))


def markdown_block() -> Column:
    """One block's Markdown from its columns."""
    text = T.escape_rule(T.escape_markdown(F.col("text")))
    heading = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2))))), F.lit(" "), text)
    item = F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(1)) - 1), F.when(F.col("ordered"), "1. ").otherwise("- "), text)
    linked = F.when(F.col("href").isNotNull() & (F.col("type") == "text") & ~F.col("text").contains("]"), text).otherwise(T.escape_block_prefix(text))
    return (
        F.when(F.col("type").isin("doc_title", "paragraph_title"), heading)
        .when(F.col("type") == "list_item", item)
        .when(F.col("type") == "table", F.col("html"))
        .when(F.col("type") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("type") == "equation", F.concat(F.lit("$$\n"), "text", F.lit("\n$$")))
        .when(F.col("type") == "quote", F.concat(F.lit("> "), text))
        .when(F.col("type") == "image", F.concat(F.lit("!["), text, F.lit("]("), F.coalesce("href", F.lit("")), F.lit(")")))
        .otherwise(linked)
    )


def html_block() -> Column:
    text = T.escape_html(F.col("text"))
    wrap = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string")
    heading = F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))
    return (
        F.when(F.col("type").isin("doc_title", "paragraph_title"), heading)
        .when(F.col("type") == "list_item", wrap("li", text)).when(F.col("type") == "table", F.col("html"))
        .when(F.col("type") == "code", F.concat(F.lit("<pre><code>"), text, F.lit("</code></pre>"))).when(F.col("type") == "quote", wrap("blockquote", text))
        .when(F.col("type") == "image", F.concat(F.lit('<img src="'), T.escape_html(F.coalesce("href", F.lit(""))), F.lit('" alt="'), text, F.lit('">')))
        .otherwise(wrap("p", text))
    )


def latex_block() -> Column:
    text = T.escape_latex(F.col("text"))
    cmd = F.when(F.col("level") <= 1, "section").when(F.col("level") == 2, "subsection").otherwise("subsubsection")
    return (
        F.when(F.col("type").isin("doc_title", "paragraph_title"), F.concat(F.lit("\\"), cmd, F.lit("{"), text, F.lit("}")))
        .when(F.col("type") == "list_item", F.concat(F.lit("\\item "), text))
        .when(F.col("type") == "code", F.concat(F.lit("\\begin{verbatim}\n"), "text", F.lit("\n\\end{verbatim}")))
        .when(F.col("type") == "equation", F.concat(F.lit("\\["), "text", F.lit("\\]"))).otherwise(text)
    )


def joined(blocks: DataFrame, key: str, block: Column, sep: str, out: str, full: bool = False) -> DataFrame:
    """(key, out): a document's blocks in page order, joined; one aggregation by document."""
    d = planned(blocks, full).select(key, F.coalesce(F.col("page_idx") if "page_idx" in blocks.columns else F.lit(0), F.lit(0)).alias("page_idx"), "idx", block.alias("__b"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "idx", F.col("__b")))), lambda x: x["__b"])
    return d.groupBy(key).agg(F.array_join(parts, sep).alias(out), F.count(F.lit(1)).alias("n_blocks"))


def to_markdown(blocks: DataFrame, key: str, full: bool = False) -> DataFrame:
    return joined(blocks, key, markdown_block(), "\n\n", "markdown", full)


def to_html(blocks: DataFrame, key: str, full: bool = False) -> DataFrame:
    return joined(blocks, key, html_block(), "\n", "html", full)


def to_latex(blocks: DataFrame, key: str, full: bool = False) -> DataFrame:
    body = joined(blocks, key, latex_block(), "\n\n", "latex", full)
    head = "\\documentclass{article}\n\\usepackage{fontspec}\n\\usepackage{hyperref}\n\\begin{document}\n"
    return body.withColumn("latex", F.concat(F.lit(head), "latex", F.lit("\n\\end{document}\n")))


def to_structured(blocks: DataFrame, key: str) -> DataFrame:
    """(key, json): pages of blocks with their Markdown."""
    page = F.coalesce(F.col("page_idx") if "page_idx" in blocks.columns else F.lit(0), F.lit(0))
    d = blocks.select(key, page.alias("page_idx"), F.struct("idx", "type", "level", markdown_block().alias("content")).alias("b"))
    pages = d.groupBy(key, "page_idx").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    return pages.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("page_idx", "blocks"))).alias("pages"))).alias("json"))


class _Grid(HTMLParser):
    """Rows of (text, rowspan, colspan) of a table element."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[list]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            span = lambda k: int(given[k]) if (given.get(k) or "").isdigit() and 0 < int(given[k]) <= 1000 else 1
            self.rows[-1].append(["", span("rowspan"), span("colspan")])
            self.open = True
        elif tag == "br" and self.open:
            self.rows[-1][-1][0] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1][0] += data


def grid_of(html: str) -> list[list[list]]:
    """Rows of [text, rowspan, colspan] of a table element's cells."""
    g = _Grid()
    g.feed(html)
    return g.rows


_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f]")


def _run(text: str, style: str = "") -> str:
    clean = _CONTROL.sub("\ufffd", text or "")
    parts = [f'<w:t xml:space="preserve">{xml_escape(x)}</w:t>' for x in clean.split("\n")]
    return f"<w:r>{style}{'<w:br/>'.join(parts)}</w:r>"


def _docx_table(html: str) -> str:
    """A table with joined cells: a cell over several rows goes on as empty ones below."""
    out, held = [], {}
    for row in grid_of(html):
        cells, col = [], 0

        def below() -> None:
            nonlocal col
            while col in held:
                left, wide = held[col]
                held[col] = (left - 1, wide)
                if left == 1:
                    del held[col]
                cells.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{wide}"/><w:vMerge/></w:tcPr><w:p/></w:tc>')
                col += wide

        for text, tall, wide in row:
            below()
            merge = '<w:vMerge w:val="restart"/>' if tall > 1 else ""
            cells.append(f'<w:tc><w:tcPr><w:gridSpan w:val="{wide}"/>{merge}</w:tcPr><w:p>{_run(text.strip())}</w:p></w:tc>')
            if tall > 1:
                held[col] = (tall - 1, wide)
            col += wide
        below()
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    edge = "".join(f'<w:{k} w:val="single" w:sz="4"/>' for k in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return f"<w:tbl><w:tblPr><w:tblBorders>{edge}</w:tblBorders></w:tblPr>{''.join(out)}</w:tbl>"


def docx_bytes(rows: list[tuple]) -> bytes:
    """A WordprocessingML package of (type, level, text, html, href, ordered) blocks: headings, lists, tables, links and code."""
    body, links = [], []
    for kind, level, text, html, href, ordered in rows:
        props = ""
        if kind in ("doc_title", "paragraph_title"):
            props = f'<w:pStyle w:val="Heading{min(max(int(level or 1), 1), 6)}"/>'
        elif kind == "list_item":
            props = f'<w:numPr><w:ilvl w:val="{min(max(int(level or 1), 1), 9) - 1}"/><w:numId w:val="{2 if ordered else 1}"/></w:numPr>'
        if kind == "table" and html:
            body.append(_docx_table(html))
            continue
        run = _run(text, '<w:rPr><w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/></w:rPr>' if kind == "code" else "")
        if href:
            links.append(href)
            run = f'<w:hyperlink r:id="l{len(links)}">{run}</w:hyperlink>'
        body.append(f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{run}</w:p>")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    heads = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7))
    formats = "".join(
        f'<w:abstractNum w:abstractNumId="{n}">' + "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{mark.format(k + 1)}"/></w:lvl>' for k in range(9)) + "</w:abstractNum>"
        for n, kind, mark in ((1, "bullet", "•"), (2, "decimal", "%{}."))
    )
    numbers = "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in (1, 2))
    base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    outer = "".join(f'<Relationship Id="l{k}" Type="{base}/hyperlink" Target="{escape(x)}" TargetMode="External"/>' for k, x in enumerate(links, 1))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    parts = "".join(f'<Override PartName="/word/{name}.xml" ContentType="{kind}.{name if name != "document" else "document.main"}+xml"/>' for name in ("document", "styles", "numbering"))
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{base}/styles" Target="styles.xml"/><Relationship Id="r2" Type="{base}/numbering" Target="numbering.xml"/>{outer}</Relationships>',
        "word/styles.xml": f"<w:styles {ns}>{heads}</w:styles>",
        "word/numbering.xml": f"<w:numbering {ns}>{formats}{numbers}</w:numbering>",
        "word/document.xml": f"<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>",
    })


def epub_bytes(rows: list[tuple], title: str) -> bytes:
    """An EPUB 3 package with one body document: headings, paragraphs, lists, tables, code and links."""
    body = []
    for kind, level, text, html, href, ordered in rows:
        shown = escape(text or "")
        if href and kind != "image":
            shown = f'<a href="{escape(href)}">{shown}</a>'
        tag = {"list_item": "li", "code": "pre", "quote": "blockquote"}.get(kind, "p")
        if kind in ("doc_title", "paragraph_title"):
            tag = f"h{min(max(int(level or 2), 1), 6)}"
        if kind == "table" and html:
            spans = lambda c: (f' rowspan="{c[1]}"' if c[1] > 1 else "") + (f' colspan="{c[2]}"' if c[2] > 1 else "")
            body.append("<table>" + "".join("<tr>" + "".join(f"<td{spans(c)}>{escape(c[0].strip())}</td>" for c in r) + "</tr>" for r in grid_of(html) if r) + "</table>")
        elif tag == "li":
            frame = "ol" if ordered else "ul"
            body.append(f"<{frame}><li>{shown}</li></{frame}>")
        else:
            body.append(f"<{tag}>{shown}</{tag}>")
    body = "".join(body)
    page = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body>{body}</body></html>'
    nav = '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>nav</title></head><body><nav epub:type="toc"><ol><li><a href="body.xhtml">Text</a></li></ol></nav></body></html>'
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>und</dc:language></metadata><manifest><item id="b" href="body.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="b"/></spine></package>'
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "content.opf": opf, "body.xhtml": page, "nav.xhtml": nav}, stored="mimetype")


def _zip(parts: dict[str, str], stored: str = "") -> bytes:
    """A zip with fixed times: equal parts, equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def to_package(blocks: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, content): DOCX or EPUB bytes; one document is one group."""
    dtype = blocks.schema[key].dataType.simpleString()
    page = F.coalesce(F.col("page_idx") if "page_idx" in blocks.columns else F.lit(0), F.lit(0))

    def run(name, group: list[tuple]) -> list[tuple]:
        rows = [r[3:] for r in group]
        return [(name, docx_bytes(rows) if kind == "docx" else epub_bytes(rows, str(name)))]

    none = F.lit(None).cast("string")
    more = [(F.col(c) if c in blocks.columns else none).alias(c) for c in ("html", "href")]
    ordered = F.coalesce(F.col("ordered") if "ordered" in blocks.columns else F.lit(False), F.lit(False)).alias("ordered")
    d = planned(blocks).select(key, page.alias("page_idx"), "idx", "type", "level", "text", *more, ordered)
    return by_group(d, key, [F.asc_nulls_last("page_idx"), F.asc_nulls_last("idx")], run, f"{key} {dtype}, content binary")


def write_bundle(artifacts: DataFrame, path: str, key: str, content: str, overwrite: bool = False) -> DataFrame:
    """Writes artifacts with size and sha256 and gives the manifest; Spark's committer makes it all or nothing."""
    body = F.col(content).cast("binary")
    out = artifacts.select(F.col(key).cast("string").alias("name"), body.alias("content"), F.length(body).alias("size"), F.sha2(body, 256).alias("sha256"))
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return artifacts.sparkSession.read.parquet(path).select("name", "size", "sha256")


def load_bundle(spark, path: str) -> DataFrame:
    """A bundle's artifacts; one whose bytes differ from its digest raises."""
    d = spark.read.parquet(path)
    fine = (F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size"))
    return d.select("name", F.when(fine, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("content differs: "), "name"))).alias("content"), "size", "sha256")
