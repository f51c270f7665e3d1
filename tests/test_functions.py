import pytest
from pyspark.sql import functions as F

from foliant.functions import bbox, numbers, spans
from foliant.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "lines, text",
    [
        (["a line", "and more"], "a line and more"), (["inter-", "national"], "international"), (["self-", "made"], "self-made"), (["GLGE-", "difficult"], "GLGE-difficult"),
        (["state-of-", "the art"], "state-of-the art"), (["中文", "继续"], "中文继续"), (["see http://x.org/a", "b/c next"], "see http://x.org/ab/c next"), (["http://x.org/a", "http://y.org"], "http://x.org/a http://y.org"),
        (["pages 10-", "20"], "pages 10-20"), (["open (", "paren"], "open (paren"), (["word", ", then"], "word, then"), (["한국", "어"], "한국 어"), ([" ", "x", ""], "x"), (["ht", "tp://a.b/c"], "http://a.b/c"), ([], ""),
    ],
)
def test_line_boundaries(spark, lines, text):
    assert one(spark, lines, T.merge_lines, "array<string>") == text


def test_list_markers(spark):
    cases = {
        "- a": ("unordered", None, None, "a"), "12. b": ("ordered", 12, "decimal", "b"), "iv. c": ("ordered", 4, "lower-roman", "c"), "IIII. d": ("explicit", None, None, "d"), "b. e": ("ordered", 2, "lower-alpha", "e"),
        "i. f": ("ordered", 1, "lower-roman", "f"), "(3) g": ("explicit", None, None, "g"), "3) h": ("explicit", None, None, "h"), "[12] i": ("explicit", None, None, "i"), "plain": ("none", None, None, "plain"), "007. j": ("explicit", None, None, "j"), "9999999. k": ("explicit", None, None, "k"),
    }
    for text, (kind, value, style, body) in cases.items():
        m = one(spark, text, T.list_marker)
        assert (m.kind, m.value, m.style, m.body) == (kind, value, style, body), text


def test_escapes_and_captions(spark):
    assert one(spark, r"a*b \* \\* _", T.escape_markdown) == r"a\*b \* \\\* \_"
    assert one(spark, "# head", T.escape_block_prefix) == r"\# head" and one(spark, "#tag", T.escape_block_prefix) == "#tag"
    assert one(spark, "---", T.escape_rule) == r"\---"
    assert one(spark, r"50% of $x_1 \ {a}~^", T.escape_latex) == r"50\% of \$x\_1 \textbackslash{} \{a\}\textasciitilde{}\textasciicircum{}"
    assert one(spark, "a\x00b\x0b", T.sanitise_xml) == "a�b�"
    assert one(spark, "Table 2 (continued)", T.is_continued_caption) and one(spark, "表1（续）", T.is_continued_caption) and not one(spark, "discontinued", T.is_continued_caption)
    assert one(spark, "续表 1", T.starts_continued_caption) and one(spark, "Continued: x", T.starts_continued_caption) and not one(spark, "continuedly", T.starts_continued_caption)
    assert one(spark, "（１２）", T.formula_tag) == "12" and one(spark, r"\[ x \]", T.clean_formula) == "x"
    assert one(spark, "```py\nx = 1\n```", T.clean_code) == "x = 1"
    assert one(spark, "MCMXCIV", T.roman_value) == 1994 and one(spark, "Page 12", T.page_label) == 12 and one(spark, "- iv -", T.page_label) == 4 and one(spark, "no 3", T.page_label) is None
    assert one(spark, "Chapter 1 ..... 12", T.toc_title) == "Chapter 1" and one(spark, "{ns}Tag", T.local_name) == "tag"
    assert one(spark, "Vol. 12, p. 3", T.marginal_key) == "vol.#,p.#"


def test_page_ranges(spark):
    run = lambda raw, n=10: one(spark, raw, lambda c: numbers.page_range(c, F.lit(n)))
    assert run("1-3, 2, r1") == [0, 1, 2, 9] and run("r3-r1") == [7, 8, 9] and run("all") == list(range(10)) and run(None) == list(range(10)) and run("99") == [] and run("0") is None and run("3~4") is None
    assert one(spark, [1, 2, 3, 7, 9, 10], numbers.format_pages, "array<int>") == "1-3,7,9-10" and one(spark, [], numbers.format_pages, "array<int>") == ""
    assert one(spark, 3, numbers.sample_pages, "int") == [0, 1, 2] and len(one(spark, 100, numbers.sample_pages, "int")) == 10 and one(spark, 11, numbers.sample_pages, "int")[0] == 0


def test_dates_and_numbers(spark):
    d = numbers.property_date
    assert one(spark, "D:20240229", d) == "2024-02-29" and one(spark, "D:20230229", d) is None and one(spark, "D:2024", d) == "2024" and one(spark, "D:20240102030405+02'30'", d) == "2024-01-02T03:04:05+02:30" and one(spark, "x", d) is None
    assert one(spark, "12", numbers.property_count) == 12 and one(spark, "-1", numbers.property_count) is None
    assert [one(spark, float(v), numbers.serial_date, "double") for v in (1, 59, 60, 61, 45292)] == ["1900-01-01", "1900-02-28", None, "1900-03-01", "2024-01-01"]
    assert one(spark, 0.75, numbers.serial_time, "double") == "18:00:00" and one(spark, 1.5, numbers.general, "double") == "1.5" and one(spark, 3.0, numbers.general, "double") == "3"
    assert one(spark, [1.0, 2.0, 3.0, 4.0], lambda c: numbers.nearest_quantile(c, 0.5), "array<double>") == 3.0 and one(spark, 2.5, numbers.to_points, "double") == 3


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 13.0, 14.0, 20.0, 20.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    p, q = bbox.box(*map(F.col, "abcd")), bbox.box(*map(F.col, "efgh"))
    r = df.select(bbox.gap(p, q).alias("gap"), bbox.overlap(p, q).alias("o"), bbox.relative(p, q).alias("rel"), bbox.rotate(q, F.lit(100.0), F.lit(50.0), F.lit(91)).alias("rot"), bbox.valid(bbox.box(F.col("a"), F.col("b"), F.col("a"), F.col("d"))).alias("bad"), bbox.quad(p).alias("quad"), bbox.centre_distance(p, p).alias("z"), bbox.widths_compatible(p, q).alias("w"), bbox.affine(F.col("c"), F.col("d"), [0, 1, -1, 0, 5, 6]).alias("t")).first()
    assert r.gap == 5.0 and r.o == 0 and r.rel.right and r.rel.below and not r.rel.left and r.bad is None and len(r.quad) == 4 and r.z == 0 and not r.w
    assert tuple(r.rot) == (30.0, 13.0, 36.0, 20.0) and tuple(r.t) == (-5.0, 16.0)


def test_spans(spark):
    rows = [([("text", " ab", ["bold"], None), ("text", "cd", ["bold"], None), ("link", "x ", [], "u"), ("text", "", [], None)],)]
    df = spark.createDataFrame(rows, f"s array<{spans.SPAN}>")
    s = F.col("s")
    r = df.select(spans.normalise(s).alias("n"), spans.plain(s).alias("p"), spans.plain(spans.trim(s)).alias("t"), spans.cut(s, F.lit(2), F.lit(4)).alias("c"), spans.to_markdown(spans.normalise(s), T.escape_markdown).alias("m"), spans.map_text(s, F.upper).alias("u")).first()
    assert [x.content for x in r.n] == [" abcd", "x "] and r.p == " abcdx " and r.t == "abcdx" and [x.content for x in r.c] == ["b", "c"] and r.m == "** abcd**[x ](u)" and r.u[0].content == " AB"
