"""Registered queries of the page rules: orders laid out as lines of two-lane pages, customers as rules, parts as pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import page_tables, pages
from foliant.queries import query, table

#: Thirty-two lines a page, eight pages a document, in expressions that Spark and the SQL share.
LINE = """CAST(floor(o_orderkey / 256) AS BIGINT) AS doc, CAST(floor(o_orderkey / 32) AS BIGINT) AS page, CAST(o_orderkey % 32 AS INTEGER) AS idx, CAST(o_orderkey % 2 AS INTEGER) AS lane,
 CAST((o_orderkey % 2) * 300 + 40 + CASE WHEN o_custkey % 5 = 0 THEN 12 WHEN o_custkey % 13 = 0 THEN -8 ELSE 0 END AS DOUBLE) AS x0, CAST(50 + floor((o_orderkey % 32) / 2) * 14 + o_custkey % 3 AS DOUBLE) AS y0,
 CAST((o_orderkey % 2) * 300 + 120 + o_custkey % 170 AS DOUBLE) AS x1, CAST(60 + floor((o_orderkey % 32) / 2) * 14 + o_custkey % 3 + CASE WHEN o_custkey % 7 = 0 THEN 6 ELSE 0 END AS DOUBLE) AS y1,
 'F' || CAST(o_custkey % 4 AS STRING) AS font, o_custkey % 11 = 0 AS bold, CASE o_custkey % 10 WHEN 0 THEN '1. Scope' WHEN 1 THEN 'From: a b' WHEN 2 THEN '• item one' WHEN 3 THEN 'ends here.' WHEN 4 THEN 'goes on and'
 WHEN 5 THEN '2.1 Methods used' WHEN 6 THEN 'Chapter ...... 12' WHEN 7 THEN '[3] A note' WHEN 8 THEN 'References' ELSE 'plain words ' || o_orderstatus END AS text, CAST(o_custkey % 6 AS INTEGER) AS number"""
RULE = """CAST(floor(c_custkey / 24) AS BIGINT) AS doc, CAST(floor(c_custkey / 3) AS BIGINT) AS page, CAST(30 + c_custkey % 2 * 40 AS DOUBLE) AS x0, CAST(230 + c_custkey % 2 * 40 + c_nationkey % 5 * 100 AS DOUBLE) AS x1,
 CAST(CASE c_custkey % 3 WHEN 0 THEN 60 + c_nationkey % 4 WHEN 1 THEN 200 + c_nationkey ELSE 240 + c_nationkey END AS DOUBLE) AS y"""
PICTURE = """CAST(floor(p_partkey / 64) AS BIGINT) AS doc, CAST(floor(p_partkey / 4) AS BIGINT) AS page, CAST(p_size % 3 * 10 AS DOUBLE) + 0.2 AS x0, CAST(p_size % 2 * 10 AS DOUBLE) AS y0, CAST(400 + p_size % 3 * 100 AS DOUBLE) AS x1, CAST(500 + p_size % 2 * 200 AS DOUBLE) AS y1, p_brand AS mark"""
L = f"WITH l AS (SELECT {LINE} FROM orders), r AS (SELECT {RULE} FROM customer), i AS (SELECT {PICTURE} FROM part)"
#: The order of a lane's lines.
BY = "PARTITION BY page, lane ORDER BY y0, x0, idx"
LANE = ["page", "lane"]


def _of(spark, d, name: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=table(spark, d, name))


def lines(spark, d) -> DataFrame:
    return _of(spark, d, "orders", LINE)


def rules(spark, d) -> DataFrame:
    return _of(spark, d, "customer", RULE)


def pictures(spark, d) -> DataFrame:
    return _of(spark, d, "part", PICTURE)


@query(L + """, g AS (SELECT page, font, sum(length(text)) AS n FROM l GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, font) AS k FROM g)
 SELECT page, font, CAST(n AS DOUBLE) / total AS coverage, CAST(b AS DOUBLE) / total AS bold_share FROM t JOIN (SELECT page, sum(length(text)) AS total, sum(CASE WHEN bold THEN length(text) ELSE 0 END) AS b FROM l GROUP BY page) USING (page) WHERE k = 1""")
def typography(spark, d):
    return pages.typography(lines(spark, d), ["page"])


PROFILE = """(SELECT page, lane, height, font, bold_share FROM (SELECT page, lane, median(y1 - y0) AS height, sum(CASE WHEN bold THEN x1 - x0 ELSE 0 END) / sum(x1 - x0) AS bold_share FROM l GROUP BY ALL)
 JOIN (SELECT page, lane, font, row_number() OVER (PARTITION BY page, lane ORDER BY w DESC, font) AS k FROM (SELECT page, lane, font, sum(x1 - x0) AS w FROM l GROUP BY ALL)) USING (page, lane) WHERE k = 1)"""


@query(L + f" SELECT * FROM {PROFILE}")
def lane_profile(spark, d):
    return pages.lane_profile(lines(spark, d), LANE)


GAP = f"""h AS (SELECT page, lane, median(y1 - y0) AS height FROM l GROUP BY ALL), p AS (SELECT *, y1 - y0 AS hh, lag(y1 - y0) OVER w AS ph, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM l WINDOW w AS ({BY})),
 s AS (SELECT p.page, p.lane, y0 - py1 AS gap, row_number() OVER (PARTITION BY p.page, p.lane ORDER BY y0 - py1, idx) AS k, count(*) OVER (PARTITION BY p.page, p.lane) AS n FROM p JOIN h USING (page, lane)
 WHERE greatest(hh, ph) <= 1.35 * least(hh, ph) AND least(x1, px1) > greatest(x0, px0) AND y0 - py1 BETWEEN -0.25 * height AND 2 * height),
 u AS (SELECT page, lane, median(gap) AS regular FROM s WHERE k <= ceil(n * 0.6) GROUP BY ALL),
 v AS (SELECT page, lane, any_value(regular) AS regular, median(abs(gap - regular)) AS mad FROM s JOIN u USING (page, lane) WHERE k <= ceil(n * 0.6) GROUP BY ALL),
 gaps AS (SELECT page, lane, height, coalesce(regular, 0.35 * height) AS regular, coalesce(mad, 0) AS mad FROM h LEFT JOIN v USING (page, lane))"""


@query(L + f", {GAP} SELECT * FROM gaps")
def lane_gap(spark, d):
    return pages.lane_gap(lines(spark, d), LANE)


@query(L + f""", {GAP} SELECT page, lane, idx, CAST(sum(CASE WHEN font = pf AND greatest(hh, ph) <= 1.35 * least(hh, ph) AND y0 - py1 <= regular + 3 * mad + 0.1 * height AND x0 - px0 < 0.8 * height THEN 0 ELSE 1 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph
 FROM (SELECT *, lag(font) OVER ({BY}) AS pf FROM p) JOIN gaps USING (page, lane)""")
def row_paragraphs(spark, d):
    return pages.paragraphs(lines(spark, d), LANE).select("page", "lane", "idx", "paragraph")


@query(L + """, b AS (SELECT *, CAST(floor(y1 / 3) AS BIGINT) AS baseline FROM l), o AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY page, baseline ORDER BY x0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 8 * (y1 - y0) THEN 0 ELSE 1 END AS nw FROM b),
 q AS (SELECT *, sum(nw) OVER (PARTITION BY page, baseline ORDER BY x0, idx ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT page, baseline, CAST(run AS BIGINT) AS run, string_agg(text, ' ' ORDER BY x0, idx) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM q GROUP BY page, baseline, run""")
def baseline_runs(spark, d):
    return pages.baseline_runs(lines(spark, d), ["page"], 3.0, 8.0)


@query(L + " SELECT a.page, a.idx AS i, b.idx AS j FROM l a JOIN l b ON a.page = b.page AND a.idx < b.idx AND abs(a.y1 - b.y1) <= 2")
def same_baseline_pairs(spark, d):
    return pages.same_baseline_pairs(lines(spark, d), ["page"], 2.0)


@query(L + """ SELECT page, idx, above, distance FROM (SELECT a.page, a.idx, b.idx AS above, a.y0 - b.y1 AS distance, row_number() OVER (PARTITION BY a.page, a.idx ORDER BY a.y0 - b.y1, b.idx) AS k
 FROM l a JOIN l b ON a.page = b.page AND a.idx <> b.idx AND a.y0 - b.y1 BETWEEN 0 AND 200 AND least(a.x1, b.x1) > greatest(a.x0, b.x0)) WHERE k = 1""")
def line_above(spark, d):
    return pages.line_above(lines(spark, d), ["page"])


@query(L + f""", e AS (SELECT page, lane, x0 AS edge FROM (SELECT page, lane, x0, row_number() OVER (PARTITION BY page, lane ORDER BY count(*) DESC, x0) AS k FROM l GROUP BY page, lane, x0) WHERE k = 1),
 o AS (SELECT l.*, x0 <= edge - 6 AS out_, sum(CASE WHEN x0 <= edge - 6 THEN 1 ELSE 0 END) OVER (PARTITION BY page, lane) >= 2 AS many FROM l JOIN e USING (page, lane))
 SELECT page, lane, idx, CAST(sum(CASE WHEN out_ AND many THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM o""")
def hanging_groups(spark, d):
    return pages.hanging_groups(lines(spark, d), LANE).select("page", "lane", "idx", "entry")


@query(L + rf""" SELECT page, lane, idx FROM (SELECT *, max(x1) OVER (PARTITION BY page, lane) AS r, lag(text) OVER ({BY}) AS pt, lag(x1) OVER ({BY}) AS px FROM l)
 WHERE regexp_matches(pt, '[.!?。！？]$') AND px + (x1 - x0) * length(regexp_extract(text, '^\S+', 0)) / length(text) < r""")
def prose_breaks(spark, d):
    return pages.prose_breaks(lines(spark, d), LANE)


@query(L + " SELECT page, lane, idx FROM (SELECT *, count(*) OVER (PARTITION BY page, lane, round(x0)) AS n FROM l WHERE starts_with(text, '• ')) WHERE n >= 2")
def bullet_breaks(spark, d):
    return pages.bullet_breaks(lines(spark, d), LANE)


@query(L + " SELECT page, lane, idx FROM l WHERE text IN ('1. Scope', 'From: a b', '[3] A note')")
def explicit_breaks(spark, d):
    from foliant.functions.text import list_marker

    kind = list_marker(F.col("text"))["kind"]
    return pages.explicit_breaks(lines(spark, d), LANE, F.when(kind != "none", kind))


@query(L + f" SELECT page, lane, idx FROM (SELECT *, lag(number) OVER ({BY}) AS a, lead(number) OVER ({BY}) AS b FROM l WHERE number > 0) WHERE number = a + 1 OR number = b - 1")
def counted_breaks(spark, d):
    return pages.counted_breaks(lines(spark, d), LANE, F.when(F.col("number") > 0, F.col("number")))


@query(L + f""", k AS (SELECT *, row_number() OVER ({BY}) AS k FROM l) SELECT page, lane, min(k) AS first, count(*) AS n FROM (SELECT *, number - k AS run FROM k WHERE number > 0) GROUP BY page, lane, run HAVING count(*) >= 2""")
def lettered_lists(spark, d):
    return pages.lettered_lists(lines(spark, d), LANE, F.when(F.col("number") > 0, F.col("number"))).select("page", "lane", "first", "n")


@query(L + " SELECT page, idx FROM (SELECT page, idx, x0, x0 + number * 2 AS x1, y0, y1 FROM l) WHERE y1 - y0 > 3 * (x1 - x0) AND ((x0 + x1) / 2 < 48 OR (x0 + x1) / 2 > 552)")
def aside_text(spark, d):
    narrow = lines(spark, d).withColumn("x1", F.col("x0") + F.col("number") * 2)
    return pages.aside_text(narrow, F.lit(600.0)).select("page", "idx")


@query(L + """ SELECT l.page, idx, 'header' AS band FROM l JOIN (SELECT page, max(y) AS y FROM r WHERE x1 - x0 >= 300 AND y <= 75 GROUP BY page) t ON l.page = t.page AND l.y1 <= t.y + 0
 UNION ALL SELECT l.page, idx, 'footer' FROM l JOIN (SELECT page, min(y) AS y FROM r WHERE x1 - x0 >= 300 AND y >= 225 GROUP BY page) t ON l.page = t.page AND l.y0 >= t.y""")
def ruled_margins(spark, d):
    ls, rs = lines(spark, d), rules(spark, d)
    head = pages.ruled_margin(ls, rs, ["page"], 300.0, True, 300.0, 0.25).withColumn("band", F.lit("header"))
    return head.union(pages.ruled_margin(ls, rs, ["page"], 300.0, False, 300.0, 0.25).withColumn("band", F.lit("footer")))


@query(L + " SELECT doc, round(x0) AS x0, round(y0) AS y0, round(x1) AS x1, round(y1) AS y1, count(DISTINCT page) AS n_pages FROM i GROUP BY doc, round(x0), round(y0), round(x1), round(y1) HAVING count(DISTINCT page) >= 3")
def repeated_pictures(spark, d):
    return pages.repeated_pictures(pictures(spark, d), "doc", "page")


@query(L + " SELECT doc, mark, count(DISTINCT page) AS n_pages FROM i WHERE (x1 - x0) * (y1 - y0) >= 0.5 * 480000 GROUP BY doc, mark HAVING count(DISTINCT page) >= 3")
def watermark_prints(spark, d):
    return pages.watermarks(pictures(spark, d), "doc", "page", "mark", F.lit(480_000.0))


@query(L + """ SELECT doc, round(x0) AS x0, round(x1) AS x1, round(y) AS y, count(DISTINCT page) AS n_pages FROM r GROUP BY doc, round(x0), round(x1), round(y)
 HAVING count(DISTINCT page) >= 2 AND count(DISTINCT CASE WHEN page IN (SELECT page FROM l WHERE bold) THEN page END) >= 2""")
def header_separators(spark, d):
    return pages.header_separators(rules(spark, d), lines(spark, d).where("bold"), "doc", "page", 2)


@query(L + """ SELECT l.page, l.idx FROM l JOIN (SELECT page, max(y) AS y FROM r WHERE y >= 150 GROUP BY page) t ON l.page = t.page JOIN (SELECT page, median(y1 - y0) AS h FROM l GROUP BY page) m ON m.page = l.page WHERE l.y0 >= t.y AND l.y1 - l.y0 < 1.2 * m.h""")
def page_footnotes(spark, d):
    return pages.page_footnotes(lines(spark, d), rules(spark, d), ["page"], 300.0, 1.2)


@query(L + rf""" SELECT page, lane, entry, string_agg(text, ' ' ORDER BY y0, x0, idx) AS text FROM (SELECT *, CAST(sum(CASE WHEN regexp_matches(text, '^(\[?\d{{1,3}}\]?|[*†‡§])\s') THEN 1 ELSE 0 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM l) GROUP BY page, lane, entry""")
def note_entries(spark, d):
    return pages.note_entries(lines(spark, d), LANE)


@query(L + " SELECT page, median(h) AS height FROM (SELECT page, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0 DESC, idx) AS k, count(*) OVER (PARTITION BY page) AS n FROM l) WHERE k <= ceil(n / 4) GROUP BY page")
def note_height(spark, d):
    return pages.note_height(lines(spark, d), ["page"])


@query(L + " SELECT page, lane, n, share FROM (SELECT page, lane, CAST(sum(t) AS BIGINT) AS n, avg(t) AS share FROM (SELECT *, CASE WHEN text = 'Chapter ...... 12' THEN 1 ELSE 0 END AS t FROM l) GROUP BY page, lane) WHERE n >= 2 AND share >= 0.15")
def index_lanes(spark, d):
    return pages.index_lanes(lines(spark, d), LANE, 2, 0.15)


@query(L + """, m AS (SELECT DISTINCT doc, page, CAST(page + CASE WHEN number < 4 THEN number % 2 ELSE number * 7 END AS BIGINT) AS value FROM l WHERE idx = 31)
 SELECT DISTINCT a.doc, a.page, a.value FROM m a JOIN m b ON a.doc = b.doc AND abs(a.page - b.page) BETWEEN 1 AND 2 AND a.value - b.value = a.page - b.page""")
def page_number_runs(spark, d):
    shift = F.when(F.col("number") < 4, F.col("number") % 2).otherwise(F.col("number") * 7)
    marks = lines(spark, d).where("idx = 31").select("doc", "page", (F.col("page") + shift).cast("long").alias("value")).distinct()
    return pages.page_number_runs(marks, "doc", "page", "value")


@query(L + f""" SELECT page, lane, idx, coalesce(last_value(CASE WHEN text = 'References' THEN 1 WHEN text IN ('1. Scope', '2.1 Methods used') THEN 0 END IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0) = 1 AS in_references FROM l""")
def reference_regions(spark, d):
    t = F.col("text")
    return pages.reference_regions(lines(spark, d), LANE, t == "References", t.rlike(r"^\d+(\.\d+)*\.? \S")).select("page", "lane", "idx", "in_references")


@query(L + f""", e AS (SELECT *, sum(CASE WHEN font = pf THEN 0 ELSE 1 END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(font) OVER ({BY}) AS pf FROM l))
 SELECT page, lane, idx, coalesce(list(idx) OVER (PARTITION BY page, lane, g ORDER BY y0, x0, idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), []) AS following FROM e""")
def following_lines(spark, d):
    return pages.following(lines(spark, d), LANE, "font").select("page", "lane", "idx", "following")


@query(L + """ SELECT page, idx, text FROM (SELECT page, idx, text, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0 DESC, y0, idx) AS k FROM l WHERE y0 < 150) JOIN (SELECT page, median(y1 - y0) AS m FROM l GROUP BY page) USING (page) WHERE k = 1 AND h >= 1.2 * m""")
def document_title(spark, d):
    return pages.document_title(lines(spark, d), ["page"], 300.0)


@query(L + f""" SELECT page, lane, idx, score FROM (SELECT l.page, l.lane, idx, CAST(CASE WHEN y1 - y0 >= 1.15 * height THEN 2 ELSE 0 END + CASE WHEN bold THEN 1 ELSE 0 END + CASE WHEN l.font <> p.font THEN 1 ELSE 0 END
 + CASE WHEN NOT regexp_matches(text, '[.!?。！？]$') THEN 1 ELSE 0 END + CASE WHEN len(string_split(text, ' ')) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS score FROM l JOIN {PROFILE} p USING (page, lane)) WHERE score >= 3""")
def lane_titles(spark, d):
    return pages.lane_titles(lines(spark, d), LANE, 2)


@query(L + f" SELECT page, lane, idx FROM (SELECT *, lag(text) OVER ({BY}) AS pt, lag(bold) OVER ({BY}) AS pb FROM l) WHERE bold AND NOT pb AND NOT regexp_matches(pt, '[.!?。！？]$')")
def demoted_titles(spark, d):
    return pages.demoted_titles(lines(spark, d), LANE, "bold")


@query(L + " SELECT page, idx, CASE text WHEN '1. Scope' THEN 1 ELSE 2 END AS depth FROM l WHERE text IN ('1. Scope', '2.1 Methods used')")
def numbered_titles(spark, d):
    return pages.numbered_titles(lines(spark, d), ["page"])


@query(L + """ SELECT doc, font, bold, height, n FROM (SELECT doc, font, bold, round(y1 - y0) AS height, count(*) AS n, count(DISTINCT page) AS p, sum(count(*)) OVER (PARTITION BY doc) AS every FROM l GROUP BY doc, font, bold, round(y1 - y0)) WHERE p >= 2 AND n < 0.2 * every""")
def recurrent_styles(spark, d):
    return pages.recurrent_styles(lines(spark, d), "doc", "page")


@query(L + f""" SELECT page, lane, idx FROM (SELECT *, count(*) OVER (PARTITION BY page, lane) AS n FROM (SELECT *, max(x1 - x0) OVER (PARTITION BY page, lane) AS f, lead(x1 - x0) OVER ({BY}) AS nx FROM l) WHERE x1 - x0 <= 0.6 * f AND nx >= 0.9 * f AND NOT regexp_matches(text, '[.!?。！？]$')) WHERE n >= 2""")
def body_sections(spark, d):
    return pages.body_sections(lines(spark, d), LANE)


@query(L + f" SELECT page, lane, idx FROM (SELECT *, lag(font) OVER ({BY}) AS b, lead(font) OVER ({BY}) AS a FROM l) WHERE a = b AND font <> a AND len(string_split(text, ' ')) <= 3")
def typography_resets(spark, d):
    return pages.typography_resets(lines(spark, d), LANE)


@query(r"""SELECT doc_id, font, count(*) AS n, sum(CASE WHEN generated THEN 1 ELSE 0 END)::BIGINT AS generated, sum(CASE WHEN regexp_matches(char, '^[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}]') THEN 1 ELSE 0 END)::BIGINT AS cjk FROM
 (SELECT doc_id, c AS char, CASE WHEN c >= 'a' AND c <= 'z' THEN 'lower' ELSE 'other' END AS font, c = ' ' AS generated FROM (SELECT doc_id, unnest(string_split(translate(text, 'eat', '東京語'), '')) AS c FROM documents) WHERE c <> '') GROUP BY doc_id, font""")
def font_counts(spark, d):
    t = F.translate("text", "eat", "東京語")
    c = table(spark, d, "documents").select("doc_id", F.explode(F.split(t, "")).alias("char")).where("char <> ''")
    c = c.withColumn("font", F.when((F.col("char") >= "a") & (F.col("char") <= "z"), "lower").otherwise("other")).withColumn("generated", F.col("char") == " ")
    return pages.font_counts(c, ["doc_id"])


@query("""SELECT user_id, min(event_id) AS first, max(event_id) AS last, any_value(angle) AS angle, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT user_id, event_id, angle, CASE WHEN angle IS NOT DISTINCT FROM lag(angle) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 90 ELSE 0 END AS angle FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))) GROUP BY user_id, g""")
def writing_runs(spark, d):
    e = table(spark, d, "events").withColumn("angle", F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 90 ELSE 0 END"))
    return pages.runs_by(e, ["user_id"], "event_id", "angle")


@query(L + """ SELECT page, run, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM (SELECT *, CAST(sum(CASE WHEN x0 - px <= 0.3 * m THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY x0, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
 FROM (SELECT *, lag(x1) OVER (PARTITION BY page ORDER BY x0, idx) AS px, avg(x1 - x0) OVER (PARTITION BY page) AS m FROM (SELECT page, idx, x0 + number * 40 AS x0, x0 + number * 40 + 20 AS x1 FROM l))) GROUP BY page, run""")
def visual_runs(spark, d):
    c = lines(spark, d).withColumn("x0", F.col("x0") + F.col("number") * 40).withColumn("x1", F.col("x0") + 20)
    return pages.visual_runs(c, ["page"], 0.3)


@query(L + """ SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY k, CASE WHEN k = 1 THEN 0 ELSE y0 END, CASE WHEN k = 1 THEN 0 ELSE x0 END, idx) - 1 AS position FROM (SELECT *, CASE number WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS k FROM l)""")
def marginal_order(spark, d):
    kind = F.expr("CASE number WHEN 1 THEN 'header' WHEN 2 THEN 'footer' WHEN 3 THEN 'page_number' ELSE 'text' END")
    return pages.marginal_order(lines(spark, d).withColumn("type", kind), ["page"], "type").select("page", "idx", F.col("position").cast("long").alias("position"))


@query(L + " SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 14), CASE WHEN number = 5 THEN 1 ELSE 0 END, x0, idx) - 1 AS position FROM l")
def equation_order(spark, d):
    return pages.equation_order(lines(spark, d), ["page"], F.col("number") == 5, 14.0).select("page", "idx", F.col("position").cast("long").alias("position"))


@query(L + " SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY lane, y0, x0, idx) - 1 AS position FROM l")
def two_column_order(spark, d):
    """Pages of two clean columns: the left one from the top, then the right one."""
    from foliant.operators.layout import reading_order

    even = lines(spark, d).withColumn("x1", F.col("lane") * 300 + 200.0)
    return reading_order(even.select("page", "idx", "x0", "y0", "x1", "y1"), ["page"]).select("page", "idx", F.col("position").cast("long").alias("position"))


@query(L + """, w AS (SELECT *, CASE WHEN idx = 16 THEN 1 ELSE 0 END AS wide FROM l), t AS (SELECT page, min(CASE WHEN wide = 1 THEN 50 + 8 * 14 - 3 END) AS top FROM w GROUP BY page)
 SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN wide = 1 THEN 1 WHEN y1 - 4 <= top THEN 0 ELSE 2 END, lane, y0, x0, idx) - 1 AS position FROM (SELECT w.page, idx, wide, lane, x0, CASE WHEN wide = 1 THEN top ELSE y0 END AS y0, y1, top FROM w JOIN t USING (page))""")
def wide_box_order(spark, d):
    """A box across both columns in the middle of each page: what ends above it comes first, column by column."""
    from foliant.operators.layout import reading_order

    wide = F.col("idx") == 16
    b = lines(spark, d).withColumn("y1", F.col("y1") - 4)
    b = b.withColumn("x1", F.when(wide, 590.0).otherwise(F.col("lane") * 300 + 200.0)).withColumn("y0", F.when(wide, 50.0 + 8 * 14 - 3).otherwise(F.col("y0")))
    return reading_order(b.select("page", "idx", "x0", "y0", "x1", "y1"), ["page"]).select("page", "idx", F.col("position").cast("long").alias("position"))


# ---- tables, drawings, marks

RECT = """CAST(floor(o_orderkey / 12) AS BIGINT) AS page, o_orderkey AS idx, CAST(o_orderkey % 4 * 50 + CASE WHEN o_custkey % 47 = 0 THEN 7 ELSE 0 END AS DOUBLE) AS x0, CAST(floor(o_orderkey % 12 / 4) * 19 AS DOUBLE) AS y0,
 CAST(o_orderkey % 4 * 50 + 48 + CASE WHEN o_custkey % 47 = 0 THEN 7 ELSE 0 END AS DOUBLE) AS x1, CAST(floor(o_orderkey % 12 / 4) * 19 + 18 + CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS y1, CAST(o_custkey % 9 AS INTEGER) AS segments, CAST(o_custkey % 4 AS INTEGER) AS curves"""
CELL = """CAST(floor(o_orderkey / 32) AS BIGINT) AS page, CAST(floor(o_orderkey % 32 / 4) AS INTEGER) AS row, CAST(o_orderkey % 4 AS INTEGER) AS col, CAST(o_orderkey % 4 * 100 + 80 + CASE WHEN o_custkey % 9 = 0 THEN 3 ELSE 0 END AS DOUBLE) AS x1, CAST(1 + o_custkey % 2 AS INTEGER) AS colspan,
 CASE WHEN o_orderkey % 32 < 4 AND o_custkey % 3 > 0 THEN CAST(1990 + o_custkey % 30 AS STRING) WHEN o_orderkey % 4 = 0 THEN 'name of row *' WHEN o_custkey % 6 = 0 THEN 'a label' ELSE CAST(o_custkey AS STRING) END AS text"""
PLACE = """CAST(floor(p_partkey / 8) AS BIGINT) AS page, CAST(p_partkey % 8 AS INTEGER) AS cell, CAST(p_partkey % 4 * 160 AS DOUBLE) AS cx0, CAST(floor(p_partkey % 8 / 4) * 120 + 45 AS DOUBLE) AS cy0, CAST(p_partkey % 4 * 160 + 120 + p_size AS DOUBLE) AS cx1, CAST(floor(p_partkey % 8 / 4) * 120 + 150 AS DOUBLE) AS cy1"""
M = L + f", q AS (SELECT {RECT} FROM orders), c AS (SELECT {CELL} FROM orders), z AS (SELECT {PLACE} FROM part)"


def rects(spark, d) -> DataFrame:
    return _of(spark, d, "orders", RECT)


def cells(spark, d) -> DataFrame:
    return _of(spark, d, "orders", CELL)


def places(spark, d) -> DataFrame:
    return _of(spark, d, "part", PLACE)


TABLES = """(SELECT doc, "left", "right", min(x0) AS x0, max(x1) AS x1, min(y) AS top, max(y) AS bottom, count(*) AS n FROM (SELECT *, sum(CASE WHEN y - p <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, "left", "right" ORDER BY y) AS t
 FROM (SELECT *, lag(y) OVER (PARTITION BY doc, "left", "right" ORDER BY y) AS p FROM (SELECT *, round(x0 / 2) AS "left", round(x1 / 2) AS "right" FROM r))) GROUP BY doc, "left", "right", t HAVING count(*) >= 2)"""


@query(M + f" SELECT * FROM {TABLES}")
def ruled_tables(spark, d):
    return page_tables.ruled_tables(rules(spark, d), ["doc"], 60.0, 2)


@query(M + """, b AS (SELECT page, y AS top, lead(y) OVER (PARTITION BY page ORDER BY y) AS bottom FROM (SELECT DISTINCT page, y FROM r))
 SELECT b.page, top, bottom, count(*) AS n FROM b JOIN l ON b.page = l.page AND (l.y0 + l.y1) / 2 >= top AND (l.y0 + l.y1) / 2 < bottom GROUP BY b.page, top, bottom""")
def rule_bands(spark, d):
    return page_tables.rule_bands(rules(spark, d), lines(spark, d), ["page"])


@query(M + """, e AS (SELECT DISTINCT page, round(x0 / 4) AS x, round(y0 / 4) AS y FROM l) SELECT page, n AS rows, CAST(sum(CASE WHEN k >= 0.25 * n THEN 1 ELSE 0 END) AS BIGINT) AS columns
 FROM (SELECT page, x, count(*) AS k FROM e GROUP BY page, x) JOIN (SELECT page, count(DISTINCT y) AS n FROM e GROUP BY page) USING (page) GROUP BY page, n""")
def stable_columns(spark, d):
    return page_tables.stable_columns(lines(spark, d), ["page"], 4.0, 0.25)


@query(M + """ SELECT page, rows, columns, x0, y0, x1, y1 FROM (SELECT page, count(DISTINCT round(y0)) AS rows, count(DISTINCT round(x0)) AS columns, count(DISTINCT round(x0) * 1000 + round(y0)) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM q GROUP BY page) WHERE rows >= 2 AND columns >= 2 AND n = rows * columns""")
def filled_grids(spark, d):
    return page_tables.filled_grids(rects(spark, d), ["page"])


NUM = r"regexp_matches(text, '^[-+(]?[$€£]?\d[\d,. ]*\)?%?$')"


@query(M + f' SELECT page, round(x1) AS "right", count(*) AS n, avg(CASE WHEN {NUM} THEN 1.0 ELSE 0.0 END) AS share FROM c GROUP BY page, round(x1) HAVING count(*) >= 3 AND avg(CASE WHEN {NUM} THEN 1.0 ELSE 0.0 END) >= 0.8')
def numeric_columns(spark, d):
    return page_tables.numeric_columns(cells(spark, d), ["page"])


@query(M + rf""" SELECT page, row, years, numbers FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY page ORDER BY row ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS numbers FROM (SELECT page, row, CAST(sum(CASE WHEN regexp_matches(text, '^(19|20)\d\d$') THEN 1 ELSE 0 END) AS BIGINT) AS years,
 sum(CASE WHEN {NUM} AND NOT regexp_matches(text, '^(19|20)\d\d$') THEN 1 ELSE 0 END) AS n FROM c GROUP BY page, row)) WHERE years >= 2""")
def year_headers(spark, d):
    return page_tables.year_headers(cells(spark, d), ["page"], "row")


@query(M + f" SELECT page, row, col FROM (SELECT *, max(CASE WHEN {NUM} AND col = 1 THEN row END) OVER (PARTITION BY page) AS m FROM c) WHERE m IS NULL OR row <= m")
def prose_tail(spark, d):
    data = F.col("text").rlike(page_tables.NUMERIC) & (F.col("col") == 1)
    return page_tables.without_prose_tail(cells(spark, d), ["page"], "row", data).select("page", "row", "col")


@query(M + " SELECT l.page, idx, m || ' ' || text AS text FROM (SELECT *, CASE number WHEN 1 THEN '*' WHEN 2 THEN '†' ELSE 'x' END AS m FROM l) l WHERE m = '*' AND page IN (SELECT page FROM c WHERE text = 'name of row *')")
def note_rows(spark, d):
    mark = F.expr("CASE number WHEN 1 THEN '*' WHEN 2 THEN '†' ELSE 'x' END")
    rows = lines(spark, d).select("page", "idx", F.concat(mark, F.lit(" "), "text").alias("text"))
    return page_tables.note_rows(rows, cells(spark, d), ["page"])


@query(M + f""", t AS {TABLES}, k AS (SELECT doc, idx, y1 FROM l WHERE text = 'References' AND page % 8 = 0) SELECT doc, caption, "left", "right", count(*) AS n, min(top) AS top, max(bottom) AS bottom FROM
 (SELECT t.*, (SELECT max(struct_pack(y := k.y1, i := CAST(k.idx AS BIGINT))) FROM k WHERE k.doc = t.doc AND k.y1 <= t.top).i AS caption FROM t) WHERE caption IS NOT NULL GROUP BY doc, caption, "left", "right" """)
def caption_groups(spark, d):
    captions = lines(spark, d).where("text = 'References' and page % 8 = 0").select("doc", "idx", "y1")
    return page_tables.caption_groups(page_tables.ruled_tables(rules(spark, d), ["doc"], 60.0, 2), captions, ["doc"])


COVER = "greatest(0, least(l.x1, cx1) - greatest(l.x0, cx0)) * greatest(0, least(l.y1, cy1) - greatest(l.y0, cy0)) / ((l.x1 - l.x0) * (l.y1 - l.y0))"
HOLDS = "(l.x0 + l.x1) / 2 BETWEEN cx0 AND cx1 AND (l.y0 + l.y1) / 2 BETWEEN cy0 AND cy1"


@query(M + f""", p AS (SELECT l.page, idx, cell, {COVER} AS r, {HOLDS} AS i FROM l JOIN z ON l.page = z.page), s AS (SELECT page, idx, list(struct_pack(r := r, c := cell) ORDER BY r DESC, cell DESC) AS b, sum(CASE WHEN i THEN 1 ELSE 0 END) AS n FROM p WHERE r > 0 OR i GROUP BY page, idx)
 SELECT l.page, l.idx, CASE WHEN b[1].r > 0 OR n = 1 THEN b[1].c END AS cell, coalesce(b[2].r >= 0.45 AND b[1].r - b[2].r <= 0.02, FALSE) AS ambiguous FROM l LEFT JOIN s ON l.page = s.page AND l.idx = s.idx""")
def glyph_cells(spark, d):
    return page_tables.assigned_cells(lines(spark, d).select("page", "idx", "x0", "y0", "x1", "y1"), places(spark, d), ["page"])


@query(M + " SELECT l.page, idx, arg_min(cell, struct_pack(a := cx0, b := cell)) AS track FROM l JOIN z ON l.page = z.page AND (x0 + x1) / 2 BETWEEN cx0 AND cx1 GROUP BY l.page, idx")
def column_occupancy(spark, d):
    t = places(spark, d).select("page", F.col("cell").alias("track"), F.col("cx0").alias("lo"), F.col("cx1").alias("hi"))
    return page_tables.column_occupancy(lines(spark, d).select("page", "idx", "x0", "x1"), t, ["page"])


@query(M + """, u AS (SELECT page, min(x0) AS a, max(x1) AS b FROM (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT page, x0, x1 FROM r))) GROUP BY page, g)
 SELECT z.page, cx0 AS lo, cx1 AS hi, sum(coalesce(greatest(0, least(cx1, b) - greatest(cx0, a)), 0)) / (cx1 - cx0) AS covered FROM (SELECT DISTINCT page, cx0, cx1 FROM z) z LEFT JOIN u ON z.page = u.page GROUP BY z.page, cx0, cx1""")
def rule_coverage(spark, d):
    s = places(spark, d).select("page", F.col("cx0").alias("lo"), F.col("cx1").alias("hi")).distinct()
    return page_tables.rule_coverage(s, rules(spark, d), ["page"])


@query(M + f" SELECT l.page, cell AS link, lane AS line, min(idx) AS first, max(idx) AS last, count(*) AS n FROM l JOIN z ON l.page = z.page AND {HOLDS} GROUP BY l.page, cell, lane")
def link_spans(spark, d):
    links = places(spark, d).select("page", F.col("cell").alias("link"), *[F.col(f"c{c}").alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    return page_tables.link_spans(lines(spark, d).withColumnRenamed("lane", "line"), links, ["page"])


@query(M + """, s AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, x0) - 1 AS rule, x0, x0 + 60 AS x1, y FROM (SELECT DISTINCT page, x0, y FROM r)), p AS (SELECT l.page, rule, idx, least(l.x1, s.x1) - greatest(l.x0, s.x0) AS w,
 CASE WHEN y BETWEEN l.y1 - 0.1 * (l.y1 - l.y0) AND l.y1 + 0.2 * (l.y1 - l.y0) THEN 'underline' WHEN abs(y - (l.y0 + l.y1) / 2) <= 0.15 * (l.y1 - l.y0) THEN 'strikethrough' END AS style FROM l JOIN s ON l.page = s.page)
 SELECT page, rule, style, idx FROM (SELECT *, row_number() OVER (PARTITION BY page, rule ORDER BY w DESC, idx) AS k FROM p WHERE style IS NOT NULL AND w >= 36) WHERE k = 1""")
def ruled_styles(spark, d):
    r = rules(spark, d).select("page", "x0", "y").distinct().withColumn("rule", F.row_number().over(Window.partitionBy("page").orderBy("y", "x0")) - 1)
    return page_tables.ruled_styles(lines(spark, d), r.withColumn("x1", F.col("x0") + 60), ["page"])


STACK = """SELECT *, sum(CASE WHEN {near} THEN 0 ELSE 1 END) OVER (PARTITION BY page, round(x0), round(x1) ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS t FROM
 (SELECT *, max(y1) OVER (PARTITION BY page, round(x0), round(x1) ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, lag(y1) OVER (PARTITION BY page, round(x0), round(x1) ORDER BY y0, y1) AS p FROM q)"""


@query(M + f" SELECT page, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM ({STACK.format(near='y0 - e <= 1')}) GROUP BY page, round(x0), round(x1), t HAVING count(*) >= 2")
def stacked_tiles(spark, d):
    return page_tables.stacked_tiles(rects(spark, d), ["page"])


@query(M + f' SELECT page, round(x0) AS "left", round(x1) AS "right", count(*) AS n, min(y0) AS top, max(y1) AS bottom FROM ({STACK.format(near="abs(y0 - p) <= 1")}) GROUP BY page, round(x0), round(x1), t HAVING count(*) >= 2')
def stacked_columns(spark, d):
    return page_tables.stacked_columns(rects(spark, d), ["page"])


@query(M + """ SELECT page, round(y1) AS base, round(x1 - x0) AS width, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1 FROM (SELECT page, x0, x1, y0 - segments AS y0, y1 FROM q) GROUP BY page, round(y1), round(x1 - x0) HAVING count(*) >= 3 AND count(DISTINCT round(y1 - y0)) > 1""")
def bar_charts(spark, d):
    return page_tables.bar_charts(rects(spark, d).withColumn("y0", F.col("y0") - F.col("segments")), ["page"])


@query(M + """, t AS (SELECT page, lane, number % 2 AS half, idx, y0, CASE WHEN page % 3 = 0 THEN idx * 5 ELSE idx * idx END AS v FROM l), e AS (SELECT *, v - lag(v) OVER (PARTITION BY page, lane ORDER BY y0, idx) AS s FROM (SELECT * FROM t WHERE idx < 12))
 SELECT page, lane, count(*) AS n, min(s) AS step FROM e GROUP BY page, lane HAVING count(*) >= 3 AND max(s) - min(s) <= 1e-6 AND min(s) <> 0""")
def equal_steps(spark, d):
    t = lines(spark, d).where("idx < 12").withColumn("v", F.when(F.col("page") % 3 == 0, F.col("idx") * 5).otherwise(F.col("idx") * F.col("idx")))
    return page_tables.equal_steps(t, LANE, "v")


@query(M + """ SELECT a.page, a.idx AS h, b.cell AS v FROM (SELECT page, idx, x0, x1, y1 AS y FROM l) a JOIN (SELECT page, cell, cx0 AS x, cy0 AS y0, cy1 AS y1 FROM z) b ON a.page = b.page AND a.x1 - a.x0 >= 80 AND b.y1 - b.y0 >= 80 AND abs(b.x - a.x0) <= 25 AND abs(b.y1 - a.y) <= 25""")
def crossing_axes(spark, d):
    across = lines(spark, d).select("page", "idx", "x0", "x1", F.col("y1").alias("y"))
    down = places(spark, d).select("page", F.col("cell").alias("idx"), F.col("cx0").alias("x"), F.col("cy0").alias("y0"), F.col("cy1").alias("y1"))
    return page_tables.crossing_axes(across, down, ["page"], 80.0, 25.0)


@query(M + """, e AS (SELECT a.idx AS i, b.idx AS j FROM q a JOIN q b ON a.page = b.page AND a.idx <> b.idx AND a.x0 - 1 <= b.x1 AND b.x0 <= a.x1 + 1 AND a.y0 - 1 <= b.y1 AND b.y0 <= a.y1 + 1 WHERE a.segments > 3 AND b.segments > 3),
 w AS (WITH RECURSIVE t(i, c) AS (SELECT DISTINCT i, i FROM e UNION SELECT e.j, t.c FROM t JOIN e ON e.i = t.i) SELECT i, min(c) AS component FROM t GROUP BY i)
 SELECT component, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM w JOIN q ON q.idx = w.i GROUP BY component HAVING count(*) >= 2""")
def drawings(spark, d):
    return page_tables.drawings(rects(spark, d).where("segments > 3"), ["page"], F.col("idx"), 1.0)


@query(M + " SELECT page, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(curves) AS BIGINT) AS curves FROM q GROUP BY page HAVING sum(segments) >= 40 AND sum(curves) >= 0.3 * sum(segments)")
def complex_drawings(spark, d):
    return page_tables.complex_drawings(rects(spark, d), ["page"], 40, 0.3)


ANCHOR = "(SELECT *, CASE WHEN number < 2 THEN '(' || idx || ')' ELSE text END AS t, max(x1) OVER (PARTITION BY page, lane) AS rt FROM l)"


@query(M + f" SELECT page, lane, idx, CAST(idx AS STRING) AS number FROM {ANCHOR} WHERE number < 2 AND rt - x1 <= 20")
def formula_anchors(spark, d):
    t = lines(spark, d).withColumn("text", F.when(F.col("number") < 2, F.concat(F.lit("("), F.col("idx").cast("string"), F.lit(")"))).otherwise(F.col("text")))
    return page_tables.formula_anchors(t, LANE)


@query(M + ' SELECT doc, round(x1) AS "right", count(*) AS n FROM l WHERE number < 2 GROUP BY doc, round(x1) HAVING count(*) >= 2')
def repeated_anchors(spark, d):
    return page_tables.repeated_anchors(lines(spark, d).where("number < 2"), ["doc"])


@query(M + f" SELECT page, idx FROM l WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.page = l.page AND {HOLDS})")
def unclaimed_lines(spark, d):
    return page_tables.unclaimed(lines(spark, d).select("page", "idx", "x0", "y0", "x1", "y1"), places(spark, d), ["page"]).select("page", "idx")


@query(M + """ SELECT a.page, a.idx AS i, b.idx AS j FROM l a JOIN l b ON a.page = b.page AND a.bold AND NOT b.bold AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 + 14 AND b.y0 - 14 < a.y1 AND length(a.text) >= 6 AND length(b.text) >= 6
 AND levenshtein(a.text, b.text) <= 0.15 * greatest(length(a.text), length(b.text))""")
def hidden_copies(spark, d):
    ls = lines(spark, d)
    seen = ls.where("not bold").select("page", F.col("idx").alias("jdx"), F.col("x0").alias("vx0"), (F.col("y0") - 14).alias("vy0"), F.col("x1").alias("vx1"), (F.col("y1") + 14).alias("vy1"), F.col("text").alias("vtext"))
    return page_tables.hidden_copies(ls.where("bold").select("page", "idx", "x0", "y0", "x1", "y1", "text"), seen, ["page"])


@query("SELECT doc, page, arg_max(o_totalprice, o_orderkey) AS width, arg_max(o_orderpriority, o_orderkey) AS mode FROM (SELECT *, o_custkey % 7 AS doc, o_custkey % 50 AS page FROM orders) GROUP BY doc, page")
def layout_extensions(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey % 7 AS doc", "o_custkey % 50 AS page", "o_orderkey", "o_totalprice AS width", "o_orderpriority AS mode")
    return page_tables.latest_by_page(o, "doc", "page", "o_orderkey", ["width", "mode"])


@query("""SELECT doc, page, any_value(kind) AS kind FROM (SELECT o_custkey AS doc, CAST(o_orderkey % 5 AS INTEGER) AS page, 'read' AS kind FROM orders WHERE o_orderkey % 5 < 3 GROUP BY ALL) GROUP BY doc, page
 UNION ALL SELECT c, p, NULL FROM (SELECT DISTINCT o_custkey AS c FROM orders), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS p) WHERE (c, p) NOT IN (SELECT (o_custkey, CAST(o_orderkey % 5 AS INTEGER)) FROM orders WHERE o_orderkey % 5 < 3)""")
def blank_pages(spark, d):
    o = table(spark, d, "orders")
    have = o.where("o_orderkey % 5 < 3").selectExpr("o_custkey AS doc", "CAST(o_orderkey % 5 AS INTEGER) AS page", "'read' AS kind").distinct()
    return page_tables.with_blank_pages(have, o.selectExpr("o_custkey AS doc", "4 AS n").distinct(), "doc", "page")


@query("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    got = page_tables.totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")])
    return got.withColumn("level", F.col("level").cast("long"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, d):
    got = page_tables.totals(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")], "rollup")
    return got.withColumn("level", F.col("level").cast("long"))


@query(M + " SELECT page, row, count(*) AS n, CAST(sum(colspan) AS BIGINT) AS wide, list(colspan ORDER BY col) AS colspans, list(replace(text, ' ', '') ORDER BY col) AS texts FROM c GROUP BY page, row")
def row_signatures(spark, d):
    return page_tables.row_signatures(cells(spark, d), ["page"], "row", "col")


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(28, 8))) AS DOUBLE) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(28, 8))) AS DOUBLE) / count(*) AS mean FROM orders GROUP BY o_orderstatus")
def exact_mean(spark, d):
    return page_tables.exact_mean(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")


@query(M + " SELECT page, CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS penalty FROM (SELECT page, font, count(*) AS n FROM l WHERE length(text) <= 12 GROUP BY page, font) GROUP BY page")
def repeated_siblings(spark, d):
    return page_tables.repeated_siblings(lines(spark, d), "page", "font", 12)


# ---- PDF files written from rows and read back

@query("""SELECT o_custkey AS doc, CAST(k AS INTEGER) AS page_idx, i - 1 AS n, t[i] AS char, CAST(40 + k * 10 + (i - 1) * 6 AS DOUBLE) AS x0, CAST(40 + k * 10 + i * 6 AS DOUBLE) AS x1, CAST(100 + k AS DOUBLE) AS base FROM
 (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_orderkey || ' ' || o_orderpriority AS t FROM orders) s, unnest(range(1, length(t) + 1)) u(i)""")
def pdf_chars(spark, d):
    """Each customer's orders as a PDF file, a page for each; every character where it was set."""
    from foliant.plans.pdf_writer import pdf_of
    from foliant.plans.shared import by_group
    from foliant.sources.pdf import read_marks

    def file(customer: int, rows: list[tuple]) -> list[tuple]:
        pages = [[("text", 40.0 + k * 10, 100.0 + k, 10.0, False, f"{o} {p}")] for k, (_, o, p) in enumerate(rows)]
        return [(str(customer), pdf_of(pages, packed=bool(customer % 2), width=2000.0))]

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    m = read_marks(by_group(o, "o_custkey", ["o_orderkey"], file, "path string, content binary")).where("kind = 'char'")
    return m.select(F.col("path").cast("long").alias("doc"), "page_idx", (F.col("idx") - 1).cast("long").alias("n"), F.col("text").alias("char"), F.round("x0", 2).alias("x0"), F.round("x1", 2).alias("x1"), F.round(F.col("y1") - 2, 2).alias("base"))


@query(r"""SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT doc_id, i, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) s, unnest(range(1, len(ls) + 1)) u(i)) WHERE t <> '' GROUP BY doc_id""")
def pdf_documents(spark, d):
    """Every document's lines as a PDF file, read back as blocks; the words in their order."""
    from foliant.plans.pdf_writer import to_pdf
    from foliant.sources.packages import read_documents

    lines_ = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    blocks = lines_.where(F.trim("text") != "").withColumn("type", F.lit("text"))
    got = read_documents(to_pdf(blocks, "doc").select(F.col("doc").cast("string").alias("path"), "content"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return got.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ").alias("text"))


# ---- other formats, written from rows and read back

WORDS = r"""SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS text FROM (SELECT doc_id, i, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) s, unnest(range(1, len(ls) + 1)) u(i)) WHERE t <> '' GROUP BY doc_id"""


def _as_files(spark, d, kind: str) -> DataFrame:
    """Every document's lines as paragraphs of a package, read back by the document reader; its words in their order."""
    from foliant.plans.render import to_package
    from foliant.sources.packages import read_documents

    lines_ = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    blocks = lines_.where(F.trim("text") != "").withColumn("type", F.lit("text")).withColumn("level", F.lit(None).cast("int"))
    files = to_package(blocks, "doc", kind).select(F.concat(F.col("doc").cast("string"), F.lit(f".{kind}")).alias("path"), "content")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    name = F.regexp_extract("path", r"^(\d+)", 1).cast("long")
    return read_documents(files).groupBy(name.alias("doc_id")).agg(F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " ")).alias("text"))


@query(WORDS)
def docx_documents(spark, d):
    return _as_files(spark, d, "docx")


@query(WORDS)
def epub_documents(spark, d):
    return _as_files(spark, d, "epub")


@query("""SELECT o_custkey, string_agg(o_orderkey || chr(9) || o_orderstatus || chr(9) || 'a, "b"' || chr(9) || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""")
def csv_tables(spark, d):
    """Each customer's orders as a CSV file with quoted commas and quotes, read back as a table."""
    from foliant.sources.packages import read_documents

    row = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit('"a, ""b"""'), "o_orderpriority")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))), lambda x: x["r"])
    files = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(rows, "\r\n").alias("t"))
    files = files.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.col("t").cast("binary").alias("content"))
    return read_documents(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("o_custkey"), "text")
