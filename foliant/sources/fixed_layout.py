"""Pages of placed characters: OFD packages and simple PDF streams as ``chars`` rows, and lines from characters."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.sources.packages import Package, local
from foliant.sources.pdf import marks, paragraphs

CHARS = "path string, page_idx int, char_idx int, char string, x0 double, y0 double, x1 double, y1 double, size double, error string"


def deltas(value: str, count: int) -> list[float]:
    """Character advances: 'g n v' stands for n times v."""
    out, parts, k = [], value.split(), 0
    while k < len(parts) and len(out) < count:
        if parts[k] == "g" and k + 2 < len(parts):
            out += [float(parts[k + 2])] * min(int(parts[k + 1]), count)
            k += 3
        else:
            out.append(float(parts[k]))
            k += 1
    return out[:count]


def ofd(data: bytes) -> Iterator[tuple]:
    """(page, char, x0, y0, x1, y1, size) of each text object, from the top left."""
    p = Package(data)
    root = p.xml("OFD.xml")
    doc = next(e.text for e in root.iter() if local(e.tag) == "DocRoot").lstrip("/")
    folder = doc.rsplit("/", 1)[0] if "/" in doc else ""
    for k, page in enumerate(e for e in p.xml(doc).iter() if local(e.tag) == "Page"):
        name = f"{folder}/{page.get('BaseLoc', '')}".lstrip("/")
        content = p.xml(name)
        for t in (e for e in content.iter() if local(e.tag) == "TextObject") if content is not None else ():
            bx, by = [float(v) for v in t.get("Boundary", "0 0 0 0").split()[:2]]
            size = float(t.get("Size", 0))
            for code in (e for e in t if local(e.tag) == "TextCode" and e.text):
                x, y = bx + float(code.get("X", 0)), by + float(code.get("Y", 0))
                dx, dy = deltas(code.get("DeltaX", ""), len(code.text)), deltas(code.get("DeltaY", ""), len(code.text))
                for n, c in enumerate(code.text):
                    wide = dx[n] if n < len(dx) and dx[n] else size * (1.0 if ord(c) > 0x2E7F else 0.5)
                    yield k, c, x, y - size, x + wide, y, size
                    x, y = x + (dx[n] if n < len(dx) else 0 if dy else wide), y + (dy[n] if n < len(dy) else 0)


def pdf(data: bytes) -> Iterator[tuple]:
    """(page, char, x0, y0, x1, y1, size) of a PDF's placed characters."""
    for page, _, kind, text, x0, y0, x1, y1, size, *_ in marks(data):
        if kind == "char":
            yield page, text, x0, y0, x1, y1, size


def ofd_blocks(data: bytes) -> Iterator[tuple[int, str, int | None, str]]:
    """(page, type, level, text) of an OFD package's lines as paragraphs and titles."""
    yield from paragraphs([(page, n, c, x0, y0, x1, y1, size, False) for n, (page, c, x0, y0, x1, y1, size) in enumerate(ofd(data))])


def read_chars(files: DataFrame) -> DataFrame:
    """``CHARS`` of OFD and PDF files (path, content)."""
    names = [x.split()[0] for x in CHARS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            for path, data in zip(pdf_["path"], pdf_["content"]):
                data = bytes(data)
                try:
                    rows = [(path, page, n, *rest, None) for n, (page, *rest) in enumerate(pdf(data) if data.startswith(b"%PDF") else ofd(data))]
                except (ValueError, KeyError, StopIteration, AttributeError, RuntimeError, zipfile.BadZipFile, zlib.error, ET.ParseError) as e:
                    rows = [(path, 0, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, CHARS)


def lines_of(chars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, text, x0, y0, x1, y1): characters on one baseline with no gap over two sizes; a gap over a quarter size is a space.

    Baselines are equal after rounding to half a size; rows are islands of
    the characters sorted by (baseline, x).
    """
    c = chars.where("char is not null").withColumn("__b", F.round(F.col("y1") / (F.col("size") / 2)))
    w = Window.partitionBy(*keys, "__b").orderBy("x0", "char_idx")
    gap = F.col("x0") - F.lag("x1").over(w)
    c = c.withColumn("__gap", gap).withColumn("__new", F.when(F.col("__gap") <= 2 * F.col("size"), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    cjk = r"[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
    between = ~(F.col("char").rlike(cjk) | F.lag("char").over(w).rlike(cjk))
    c = c.withColumn("__t", F.when((F.col("__new") == 0) & (F.col("__gap") > F.col("size") / 4) & between & (F.col("char") != " "), F.concat(F.lit(" "), "char")).otherwise(F.col("char")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "char_idx", "__t"))), lambda x: x["__t"])
    g = c.groupBy(*keys, "__b", "__run").agg(F.array_join(parts, "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    order = Window.partitionBy(*keys).orderBy("y0", "x0")
    return g.withColumn("line", F.row_number().over(order) - 1).drop("__b", "__run")


def distinct_glyphs(chars: DataFrame, keys: list[str], reach: float = 0.5) -> DataFrame:
    """Without a glyph painted again at its place: the earliest of equal characters within ``reach`` points.

    Glyphs meet in the nine cells around their own, by equal keys, so a page
    is never paired with itself as a whole.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    c = chars.withColumn("__cx", cell("x0")).withColumn("__cy", cell("y0"))
    around = F.array(*[F.struct((F.col("__cx") + i).alias("__cx"), (F.col("__cy") + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    first = c.select(*keys, "char", F.explode(around).alias("k"), F.col("x0").alias("fx"), F.col("y0").alias("fy"), F.col("char_idx").alias("fi")).select(*keys, "char", "k.*", "fx", "fy", "fi")
    hit = c.join(first, [*keys, "char", "__cx", "__cy"]).where((F.col("fi") < F.col("char_idx")) & (F.abs(F.col("x0") - F.col("fx")) <= reach) & (F.abs(F.col("y0") - F.col("fy")) <= reach))
    return c.join(hit.select(*keys, "char_idx").distinct(), [*keys, "char_idx"], "left_anti").drop("__cx", "__cy")


def text_or_ocr(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, verdict, reason) from pages (width, height, text, n_images): the first rule that fires sends a document to OCR."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    odd = n - F.length(F.regexp_replace(t, r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08]", ""))
    s = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width"))).alias("aspect"),
        F.sum(n).alias("chars"), F.sum(odd).alias("odd"), F.sum(F.when((F.col("n_images") > 0) & (n < 50), 1).otherwise(0)).alias("scans"),
    )
    reason = (
        F.when(F.col("aspect") > 10, "aspect").when(F.col("chars") < 50 * F.col("n"), "few characters").when(F.col("odd") >= 0.04 * F.col("chars"), "broken encoding")
        .when(F.col("scans") > F.col("n") / 2, "pictures of pages")
    )
    return s.select(doc, F.when(reason.isNull(), "text").otherwise("ocr").alias("verdict"), reason.alias("reason"))
