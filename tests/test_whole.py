"""Queries and operators on all rows and on the hard cases."""

import pytest
from pyspark.sql import functions as F

from foliant.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_every_order_has_an_occupied_matrix(spark, orders):
    got = QUERIES["occupied_matrix"](spark, SF).select("o_orderkey").distinct()
    assert got.count() == orders.select("o_orderkey").distinct().count()


def test_one_letter_marks_that_are_roman_numerals_have_their_values(spark, orders):
    got = QUERIES["list_marker_kind"](spark, SF)
    assert got.count() == orders.count()
    o = F.col("o_orderkey")
    letters = got.where(o % 6 == 4).select(F.chr(97 + o % 26).alias("c"), "value").distinct().collect()
    roman = {"c": 100, "d": 500, "i": 1, "l": 50, "m": 1000, "v": 5, "x": 10}
    assert roman.keys() & {r.c for r in letters}
    assert all(r.value == roman.get(r.c, ord(r.c) - 96) for r in letters)


def test_spans_of_whole_null_empty_and_short_texts(spark, tmp_path):
    texts = {1: None, 2: "", 3: "a", 4: "ab", 5: "short text", 6: "Ünï 漢字 " * 500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.plain, r.cut, r.n_same) for r in QUERIES["span_algebra"](spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        t = t or ""
        m = len(t) // 2
        assert got[i] == (t, t[max(m - 5, 0) : m + 5], int(t != ""))


def test_captions_and_footnotes_find_their_block_at_any_distance(spark):
    from foliant.operators.visual import caption_parents

    kinds = ["caption"] * 12 + ["table"] + ["footnote"] * 20 + ["text", "footnote"]
    box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    rows = [(1, i, k, box, "") for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc int, idx int, type string, b struct<x0 double, y0 double, x1 double, y1 double>, text string")
    got = {r.child: r.parent for r in caption_parents(docs, ["doc"]).collect()}
    assert got == {i: 12 for i in [*range(12), *range(13, 33)]}


def test_lines_with_backslashes_are_escaped(spark, tmp_path):
    text = "plain\na\\b\n\\*x*\n\\\\*x\n\\\\\\_\nC:\\a_b ~^&%$#{}\n\\"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def markdown(line):
        out, slashes = "", 0
        for c in line:
            out += ("\\" if c in "*_`~$" and slashes % 2 == 0 else "") + c
            slashes = slashes + 1 if c == "\\" else 0
        return out

    tex = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "&%$#_{}"}
    for name, brute in (("markdown_escape", markdown), ("latex_escape", lambda line: "".join(tex.get(c, c) for c in line))):
        got = {r.line_no: r[2] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: brute(line) for i, line in enumerate(text.split("\n"))}


def test_a_head_is_read_behind_a_large_script(spark):
    from foliant.sources.metadata import properties

    page = "<html lang='en'><head><script>" + "x = 1;\n" * 300_000 + "</script><title>Late</title><meta name='author' content='Ann'></head><body><title>No</title>"
    row = properties(page.encode(), "a.html")
    assert row[1:4] == ("html", "Late", ["Ann"]) and row[5] == "en"


def test_every_customers_orders_are_a_file(spark, orders):
    got = {r.suffix: (r.n, r.errors) for r in QUERIES["parse_files"](spark, SF).collect()}
    assert got["csv"] == (orders.select("o_custkey").distinct().count(), 0)
