"""File types by content."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Media types and main parts that name a container's format.
MIMETYPES = {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}
MAIN_PARTS = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx", "OFD.xml": "ofd"}
OLE_STREAMS = {"WordDocument": "doc", "PowerPoint Document": "ppt", "Workbook": "xls", "Book": "xls"}
ALIASES = {"htm": "html", "xhtml": "html", "shtml": "html", "mht": "mhtml", "tab": "tsv"}


def signature(content: Column) -> Column:
    """The format family of a binary column by its first bytes: pdf, rtf, zip, ole, mhtml, html or text."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(head.startswith("%PDF"), "pdf")
        .when(head.startswith("{\\rtf"), "rtf")
        .when(head.startswith("PK\u0003\u0004"), "zip")
        .when(F.hex(F.substring(content, 1, 8)) == "D0CF11E0A1B11AE1", "ole")
        .when(head.rlike(r"(?is)^[^<]*\bcontent-type:\s*multipart/related"), "mhtml")
        .when(head.rlike(r"(?is)^\s*(?:<\?xml[^>]*>\s*)?(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|body)\b"), "html")
        .otherwise("text")
    )


def extension(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(known, ext), ext)


def suffix_of(data: bytes, path: str = "") -> str:
    """The canonical suffix of a file: by signature, then by what its container holds, then by its name."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    ext = ALIASES.get(ext, ext)
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                kind = z.read("mimetype").decode("ascii", "replace").strip() if "mimetype" in names else ""
        except (zipfile.BadZipFile, KeyError, NotImplementedError):
            return ext or "zip"
        found = MIMETYPES.get(kind) or next((s for p, s in MAIN_PARTS.items() if p in names), None)
        return found or ("epub" if "META-INF/container.xml" in names else ext or "zip")
    if data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")):
        return next((s for name, s in OLE_STREAMS.items() if name.encode("utf-16-le") in data), ext or "ole")
    head = data[:65536].lower()
    if b"content-type: multipart/related" in head:
        return "mhtml"
    if b"<html" in head or head.lstrip().startswith(b"<!doctype html"):
        return "html"
    return ext or "txt"


def load_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content): one row for each file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def detected(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with their suffix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "suffix": [suffix_of(bytes(c), p) for c, p in zip(pdf["content"], pdf["path"])]})

    return files.select("path", "content").mapInPandas(run, "path string, suffix string")
