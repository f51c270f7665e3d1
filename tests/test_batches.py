"""Many small files and groups in one batch; fonts read once; runs of characters as single ones."""

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.operators import layout
from foliant.operators.visual import caption_parents
from foliant.plans.pdf_writer import pdf_of
from foliant.plans.shared import arrow_schema, batched_rows, by_group, dealt
from foliant.sources import main_content, pdf
from foliant.sources.markup import read_blocks
from foliant.sources.packages import read_documents


def test_pdf_fonts_are_read_once_for_a_file(monkeypatch):
    made, own = [], pdf.Font.__init__
    monkeypatch.setattr(pdf.Font, "__init__", lambda self, *a: (made.append(1), own(self, *a))[1])
    for packed in (True, False):
        made.clear()
        data = pdf_of([[("text", 40.0, 100.0, 10.0, False, f"page {k} (x\\y)"), ("text", 40.0, 120.0, 10.0, False, "語")] for k in range(5)], packed=packed)
        rows = [r for r in pdf.marks(data) if r[2] == "char"]
        assert "".join(r[3] for r in rows if r[0] == 3) == "page 3 (x\\y)語"
        assert len(made) == 2


def rows_in_batches(monkeypatch, read, df, *more):
    """Rows of each batch that the Arrow function of ``read`` gives for all of ``df`` at once."""
    held, cls = [], type(df)
    own = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, f, *a, **k: (held.append((self, f)), own(self, f, *a, **k))[1])
    read(df, *more)
    monkeypatch.undo()
    source, f = held[-1]
    return [b.num_rows for b in f(iter(source.toArrow().combine_chunks().to_batches()))]


def test_files_share_batches(spark, monkeypatch):
    files = spark.createDataFrame([(f"{k}.pdf", bytearray(pdf_of([[("text", 40.0, 100.0, 10.0, False, f"file {k}")]]))) for k in range(40)] + [("bad.pdf", bytearray(b"%PDF-1.4 nothing"))], "path string, content binary").coalesce(1)
    assert rows_in_batches(monkeypatch, pdf.read_marks, files) == [pdf.read_marks(files).count()]
    assert rows_in_batches(monkeypatch, read_documents, files) == [41]
    blocks = read_documents(files)
    assert {r["path"]: r["text"] for r in blocks.where("error is null").collect()} == {f"{k}.pdf": f"file {k}" for k in range(40)}
    assert blocks.where("error is not null").count() == 1


def test_batches_are_bounded_by_rows_and_bytes():
    arrow = arrow_schema("k int, t string, b binary")
    assert [b.num_rows for b in batched_rows(((k, None, None) for k in range(25)), arrow, 10)] == [10, 10, 5]
    assert [b.num_rows for b in batched_rows(((k, "x" * 60, b"y" * 60) for k in range(5)), arrow, 10, 200)] == [2, 2, 1]


def test_groups_are_whole_and_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), (-F.col("id")).alias("v"))
    got = by_group(rows.union(spark.sql("select null, 1L")), "k", ["v"], lambda k, g: [(k, [r[1] for r in g] == sorted(r[1] for r in g), len(g))], "k bigint, sorted boolean, n int").collect()
    assert {(r["k"], r["n"]) for r in got} == {(None, 1), *((k, 715 if k < 2 else 714) for k in range(7))}
    assert all(r["sorted"] for r in got)


def test_pdf_runs_read_as_single_characters():
    beside = [("text", 40.0, 100.0, 10.0, False, "left one"), ("text", 300.0, 100.5, 10.0, False, "right one")]
    over = [("text", 40.0, 100.0, 10.0, False, "a b c d"), ("text", 43.0, 100.0, 10.0, False, "1 2 3 4"), ("text", 40.0, 130.0, 14.0, True, "Title")]
    for page in (beside, over, [*over, *beside]):
        data = pdf_of([page, beside])
        doc = pdf.Document(data)
        chars = [(k, n, m.text, m.x0, m.y0, m.x1, m.y1, m.size, m.bold) for k, h in enumerate(doc.pages()) for n, m in enumerate(pdf.Interpreter(doc, h).run().marks) if m.kind == "char"]
        assert list(pdf.blocks(data)) == list(pdf.paragraphs(chars))
        runs = pdf.Interpreter(doc, doc.pages()[1], True).run().marks
        assert [m.text for m in runs] == ["left one", "right one"]


def test_one_tree_of_a_page_is_held(spark, monkeypatch):
    alive, most = weakref.WeakSet(), []
    own = main_content.select

    def select(html):
        most.append(len(alive))
        node, how = own(html)
        alive.add(node)
        return node, how

    monkeypatch.setattr(main_content, "select", select)
    page = pa.record_batch({"page_id": list(range(50)), "html": ["<html><body><main><p>" + "some words here " * 40 + "</p></main></body></html>"] * 50})
    assert len(list(main_content.contents([page]))) == 50 and max(most) == 0


def test_contents_of_pages_leave_in_bounded_batches(spark, monkeypatch):
    page = F.concat(F.lit("<html><body><main><h1>Title</h1><p>"), F.repeat(F.lit("some words here "), 8000), F.lit("</p></main></body></html>"))
    got = rows_in_batches(monkeypatch, main_content.main_content, spark.range(300).select(F.col("id").alias("page_id"), page.alias("html")))
    assert sum(got) == 300 and max(got) < 200


def test_blocks_of_pages_leave_in_bounded_batches(spark, monkeypatch):
    page = F.concat(F.lit("<html><body>"), F.repeat(F.lit("<p>words</p>"), 100), F.lit("</body></html>"))
    assert rows_in_batches(monkeypatch, read_blocks, spark.range(500).select(F.col("id").alias("page_id"), page.alias("html")), "page_id") == [10_000] * 5


def test_few_boxes_are_ordered_as_many(monkeypatch):
    rng = np.random.default_rng(7)
    pages = []
    for k in range(400):
        n = int(rng.integers(1, 60))
        at = rng.integers(0, 12 if k % 2 else 500, (n, 2)) * (10.0 if k % 2 else 1.0)
        pages.append(np.hstack([at, at + rng.integers(1, 60, (n, 2)) * np.where(rng.random((n, 1)) < 0.2, 4.0, 1.0)]))
    few = [layout.xy_cut(p) for p in pages]
    monkeypatch.setattr(layout, "FEW", 0)
    assert few == [layout.xy_cut(p) for p in pages]


def test_boxes_without_a_page_are_one_group(spark):
    rows = [(None, k, 0.0, 100.0 - k * 20, 50.0, 110.0 - k * 20) for k in range(5)] + [(1, 0, 0.0, 0.0, 0.0, 5.0), (1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, None, 0.0, 5.0, 5.0)]
    got = layout.reading_order(spark.createDataFrame(rows, "page int, idx int, x0 double, y0 double, x1 double, y1 double"), ["page"]).collect()
    assert {(r["page"], r["idx"]): r["position"] for r in got} == {**{(None, k): 4 - k for k in range(5)}, (1, 0): 1, (1, 1): 0, (1, 2): 2}


def test_partitions_follow_the_rows(spark):
    d = dealt(spark.range(10_000).select((F.col("id") % 1000).alias("doc"), "id"), ["doc"], 500)
    assert d.rdd.getNumPartitions() == 20
    blocks = spark.range(1000).select((F.col("id") % 10).alias("doc"), F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, "table").otherwise("caption").alias("type"), F.struct(*[F.lit(1.0).alias(s) for s in ("x0", "y0", "x1", "y1")]).alias("b"))
    assert "REPARTITION_BY_NUM" in caption_parents(blocks, ["doc"])._jdf.queryExecution().toString()
