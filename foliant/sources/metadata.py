"""Document properties without the body."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import suppress
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.numbers import property_date
from foliant.sources import pdf
from foliant.sources.detect import suffix_of
from foliant.sources.packages import Package, local

SCHEMA = "path string, suffix string, title string, authors array<string>, subject string, language string, created_raw string, modified_raw string, pages int, error string"

# Element names of Dublin Core and the office formats, by property.
FIELDS = {"title": "title", "creator": "author", "initial-creator": "author", "subject": "subject", "language": "language", "created": "created", "creation-date": "created", "modified": "modified", "date": "modified"}


class _Body(Exception):
    """The body begins."""


class _Head(HTMLParser):
    """Reads title and meta elements and stops at the body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, list[str]] = {}
        self.inside = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "body":
            raise _Body
        self.inside = tag == "title"
        if tag == "html" and a.get("lang"):
            self.found.setdefault("language", []).append(a["lang"])
        if tag == "meta" and a.get("content"):
            name = (a.get("property") or a.get("name") or "").lower()
            key = {"og:title": "og", "author": "author", "dc.creator": "author", "dc.title": "og", "description": "subject", "dc.language": "language", "article:published_time": "created", "article:modified_time": "modified"}.get(name)
            if key:
                self.found.setdefault(key, []).append(a["content"])

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found.setdefault("title", []).append(data)


def _from_xml(root: ET.Element | None, found: dict[str, list[str]]) -> None:
    for e in root.iter() if root is not None else ():
        key = FIELDS.get(local(e.tag).lower())
        if key and e.text and e.text.strip():
            found.setdefault(key, []).append(e.text.strip())


def properties(data: bytes, path: str = "") -> tuple:
    """A row of ``SCHEMA``."""
    suffix = suffix_of(data, path)
    found: dict[str, list[str]] = {}
    pages = None
    try:
        if suffix in ("docx", "xlsx", "pptx"):
            p = Package(data)
            _from_xml(p.xml("docProps/core.xml"), found)
            app = p.xml("docProps/app.xml")
            n = next((e.text for e in app.iter() if local(e.tag) in ("Pages", "Slides") and e.text), None) if app is not None else None
            pages = int(n) if n and n.isdigit() else None
        elif suffix in ("odt", "ods", "odp"):
            _from_xml(Package(data).xml("meta.xml"), found)
        elif suffix == "epub":
            p = Package(data)
            opf = next(e.get("full-path") for e in p.xml("META-INF/container.xml").iter() if local(e.tag) == "rootfile")
            root = p.xml(opf)
            _from_xml(next((e for e in root if local(e.tag) == "metadata"), None), found)
            pages = sum(local(e.tag) == "itemref" for e in root.iter())
        elif suffix in ("html", "mhtml"):
            h = _Head()
            with suppress(_Body):
                h.feed(data.decode("utf-8", "replace"))
            found = h.found
            if "og" in found:
                found["title"] = found["og"][:1]
        elif suffix == "rtf":
            for word, key in ((b"title", "title"), (b"author", "author"), (b"subject", "subject")):
                if m := re.search(rb"\{\\" + word + rb" ([^{}]*)\}", data):
                    found[key] = [m[1].decode("cp1252", "replace").strip()]
        elif suffix == "pdf":
            doc = pdf.Document(data)
            for word, key in (("Title", "title"), ("Author", "author"), ("Subject", "subject"), ("CreationDate", "created"), ("ModDate", "modified")):
                if word in (info := pdf.metadata(doc)):
                    found[key] = [info[word]]
            pages = len(doc.pages()) or None
    except (ValueError, TypeError, KeyError, IndexError, StopIteration, AttributeError, zipfile.BadZipFile, ET.ParseError) as e:
        return path, suffix, None, [], None, None, None, None, None, f"{type(e).__name__}: {e}"
    one = lambda k: " ".join("".join(found[k][:1] if k != "title" else found[k]).replace("\0", "").split()) or None if k in found else None
    authors = list(dict.fromkeys(a.strip() for a in found.get("author", []) if a.strip()))
    return path, suffix, one("title"), authors, one("subject"), one("language"), one("created"), one("modified"), pages, None


def read_metadata(files: DataFrame) -> DataFrame:
    """Properties of files (path, content), dates as ISO text of their own precision."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [properties(bytes(c), p) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(rows, columns=names).astype({"pages": "Int32"})

    out = files.select("path", "content").mapInPandas(run, SCHEMA)
    return out.withColumn("created", property_date(F.col("created_raw"))).withColumn("modified", property_date(F.col("modified_raw"))).drop("created_raw", "modified_raw")
