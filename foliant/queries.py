"""The registered queries of the document operators, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import bbox, numbers, spans
from foliant.functions import text as T
from foliant.operators import layout, relational, tables
from foliant.operators.components import connected_components
from foliant.plans import render
from foliant.sources import markup
from foliant.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- what the queries run on

BOXES_SQL = """SELECT l_orderkey AS doc, l_linenumber AS idx, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST((l_suppkey * 7 + l_linenumber * 40) % 800 AS DOUBLE) AS y0,
 l_partkey % 600 + 10 + l_quantity AS x1, CAST((l_suppkey * 7 + l_linenumber * 40) % 800 + 8 + l_linenumber * 3 AS DOUBLE) AS y1 FROM lineitem"""
LINES_SQL = "SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t, unnest(range(1, len(ls) + 1)) u(i)"


def boxes(spark, d) -> DataFrame:
    top = (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 40) % 800
    left = F.col("l_partkey") % 600
    b = bbox.box(left, top, left + 10 + F.col("l_quantity"), top + 8 + F.col("l_linenumber") * 3)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), b.alias("b"))


def lines(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


# ---- scans

@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
 nullif(lower(regexp_extract(html, '(?i)<html[^>]*\blang="([A-Za-z-]+)"', 1)), '') AS lang FROM pages""")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", markup.title(F.col("html")).alias("title"), markup.language(F.col("html")).alias("lang"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s')) AS n_links FROM pages")
def html_link_count(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("n_links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", markup.visible_text(F.col("html")).alias("text"))


@query()
def html_blocks(spark, d):
    return markup.read_blocks(table(spark, d, "pages"), "page_id", base="url")


@query()
def html_block_types(spark, d):
    b = markup.read_blocks(table(spark, d, "pages"), "page_id")
    return b.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query()
def html_markdown(spark, d):
    return render.to_markdown(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id")


@query()
def html_render(spark, d):
    return render.to_html(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id")


@query()
def latex_render(spark, d):
    return render.to_latex(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id")


@query()
def structured_content_json(spark, d):
    return render.to_structured(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id")


@query()
def docx_render(spark, d):
    out = render.to_package(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id", "docx")
    return out.select("page_id", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


@query()
def epub_render(spark, d):
    out = render.to_package(markup.read_blocks(table(spark, d, "pages"), "page_id"), "page_id", "epub")
    return out.select("page_id", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


@query(r"""SELECT page_id, CASE WHEN starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(html, '{\rtf') THEN 'rtf' WHEN regexp_matches(html, '(?is)^\s*<(!doctype html|html|head|body)\b') THEN 'html' ELSE 'text' END AS kind FROM pages""")
def sniff_signature(spark, d):
    from foliant.sources.detect import signature

    return table(spark, d, "pages").select("page_id", signature(F.col("html").cast("binary")).alias("kind"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path,
 nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.try_parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(u, F.lit("HOST")).alias("host"), F.nullif(F.try_parse_url(u, F.lit("PATH")), F.lit("")).alias("path"), F.try_parse_url(u, F.lit("QUERY"), F.lit("page")).alias("page"))


@query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(u, '[\x00-\x20\x7f]') AND NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') AND lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto', 'ftp') THEN u END AS link
 FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'javascript:' || url WHEN 2 THEN 'http://me@' || page_id WHEN 3 THEN '/rel/' || page_id ELSE url || ' x' END AS u FROM pages)""")
def url_sanitise(spark, d):
    i = F.col("page_id")
    u = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("javascript:"), "url")).when(i % 5 == 2, F.concat(F.lit("http://me@"), i.cast("string"))).when(i % 5 == 3, F.concat(F.lit("/rel/"), i.cast("string"))).otherwise(F.concat("url", F.lit(" x")))
    return table(spark, d, "pages").select("page_id", markup.safe_link(u).alias("link"))


# ---- text

@query(f"""SELECT doc_id, line_no, translate(line, '{T.FULL_ALNUM}', '{T.HALF_ALNUM}') AS folded FROM ({LINES_SQL}) l""")
def fullwidth_fold(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.full_to_half_alnum(F.col("line")).alias("folded"))


@query(f"""SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '[\\s\\p{{Z}}]+', '', 'g') AS key FROM ({LINES_SQL}) l""")
def marginal_keys(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.marginal_key(F.col("line")).alias("key"))


@query(f"""SELECT doc_id, line_no, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM ({LINES_SQL}) l""")
def html_escape(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.escape_html(F.col("line")).alias("html"))


@query(f"""SELECT doc_id, line_no, array_to_string(list_transform(regexp_extract_all(line, '(?s)\\\\.|.'), lambda t: CASE WHEN t IN ('*', '_', '`', '~', '$') THEN chr(92) || t ELSE t END), '') AS md FROM ({LINES_SQL}) l""")
def markdown_escape(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.escape_markdown(F.col("line")).alias("md"))


@query(f"""SELECT doc_id, line_no, array_to_string(list_transform(regexp_extract_all(line, '(?s).'), lambda t: CASE WHEN t IN ('&', '%', '$', '#', '_', '{{', '}}') THEN chr(92) || t WHEN t = '~' THEN chr(92) || 'textasciitilde{{}}' WHEN t = '^' THEN chr(92) || 'textasciicircum{{}}' WHEN t = chr(92) THEN chr(92) || 'textbackslash{{}}' ELSE t END), '') AS latex FROM ({LINES_SQL}) l""")
def latex_escape(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.escape_latex(F.col("line")).alias("latex"))


@query(f"""SELECT doc_id, line_no, left(line, 1) IN ('-', '*', '+', '•', '●', '○', '▪', '▫', '◦', '‣', '⁃', '–', '—') AND (length(line) = 1 OR substr(line, 2, 1) IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))
 OR left(line, 1) BETWEEN '①' AND '⑳' OR regexp_matches(line, '^[(（]?([0-9]+|[A-Za-z]|[IVXLCDMivxlcdm]+)[.．、)）]') OR regexp_matches(line, '^[\\[［][0-9]+[\\]］]') OR length(line) > length(ltrim(line, '一二三四五六七八九十百')) AND left(ltrim(line, '一二三四五六七八九十百'), 1) IN ('、', '.', '．', ')', '）') AS starts FROM ({LINES_SQL}) l""")
def list_item_starts(spark, d):
    return lines(spark, d).select("doc_id", "line_no", T.starts_list_item(F.col("line")).alias("starts"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'unordered' WHEN 1 THEN CASE WHEN o_orderkey > 1000000 THEN 'explicit' ELSE 'ordered' END WHEN 2 THEN 'explicit' WHEN 3 THEN 'explicit' WHEN 4 THEN 'ordered' ELSE 'none' END AS kind,
 CASE o_orderkey % 6 WHEN 1 THEN CASE WHEN o_orderkey <= 1000000 THEN o_orderkey END WHEN 4 THEN CASE o_orderkey % 26 WHEN 2 THEN 100 WHEN 3 THEN 500 WHEN 8 THEN 1 WHEN 11 THEN 50 WHEN 12 THEN 1000 WHEN 21 THEN 5 WHEN 23 THEN 10 ELSE o_orderkey % 26 + 1 END END AS value FROM orders""")
def list_marker_kind(spark, d):
    o = F.col("o_orderkey")
    n = o.cast("string")
    mark = F.when(o % 6 == 0, "-").when(o % 6 == 1, F.concat(n, F.lit("."))).when(o % 6 == 2, F.concat(F.lit("["), n, F.lit("]"))).when(o % 6 == 3, F.concat(n, F.lit(")"))).when(o % 6 == 4, F.concat(F.chr(97 + o % 26), F.lit("."))).otherwise("")
    m = T.list_marker(F.concat(mark, F.lit(" x"), n))
    return table(spark, d, "orders").select("o_orderkey", m["kind"].alias("kind"), m["value"].cast("long").alias("value"))


@query(f"""SELECT doc_id, line_no, ends_with(t, '(continued)') OR regexp_matches(t, '(^|[^a-z])continued$') OR ends_with(t, '(cont.)') OR contains(t, '(continued)') AS continued
 FROM (SELECT doc_id, line_no, lower(trim(CASE WHEN line_no % 3 = 0 THEN line || ' (Continued)' WHEN line_no % 3 = 1 THEN line || ' continued' ELSE line END)) AS t FROM ({LINES_SQL}) l)""")
def continuation_caption(spark, d):
    n = F.col("line_no")
    t = F.when(n % 3 == 0, F.concat("line", F.lit(" (Continued)"))).when(n % 3 == 1, F.concat("line", F.lit(" continued"))).otherwise(F.col("line"))
    return lines(spark, d).select("doc_id", "line_no", T.is_continued_caption(t).alias("continued"))


@query()
def line_boundary_join(spark, d):
    return table(spark, d, "documents").select("doc_id", T.merge_lines(F.split("text", "\n")).alias("text"))


@query(r"""SELECT doc_id, length(text) AS n, CAST(length(regexp_replace(text, '[^\p{P}\p{S}]', '', 'g')) AS BIGINT) AS punctuation, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS digits,
 CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS capitals, CAST(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]', '', 'g')) AS BIGINT) AS cjk,
 CAST(length(regexp_replace(text, '[^\x{FFFD}\x00-\x08]', '', 'g')) AS BIGINT) AS broken FROM documents""")
def text_quality_signals(spark, d):
    left = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", "")).cast("long")
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), left(r"\p{P}\p{S}").alias("punctuation"), left("0-9").alias("digits"), left(r"\p{Lu}").alias("capitals"), left(r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}").alias("cjk"), left(r"\x{FFFD}\x00-\x08").alias("broken"))


@query(r"""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) / length(text) ELSE 0 END, 6) AS latin,
 round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{P}]', '', 'g')) / length(text) ELSE 0 END, 6) AS marks FROM documents""")
def script_ratios(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.share(F.col("text"), r"\p{IsLatin}"), 6).alias("latin"), F.round(T.share(F.col("text"), r"\p{P}"), 6).alias("marks"))


@query(f"""SELECT key, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_lines FROM (SELECT key, doc_id, count(*) AS n FROM
 (SELECT doc_id, regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '[\\s\\p{{Z}}]+', '', 'g') AS key FROM ({LINES_SQL}) l) WHERE key <> '' GROUP BY 1, 2) GROUP BY key HAVING count(*) >= 3""")
def repeated_lines_cross_doc(spark, d):
    return layout.repeated_lines(lines(spark, d))


@query(f"""SELECT doc_id, key, count(*) AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '[\\s\\p{{Z}}]+', '', 'g') AS key FROM ({LINES_SQL}) l) WHERE key <> '' GROUP BY ALL HAVING count(*) >= 2""")
def repeated_lines(spark, d):
    k = lines(spark, d).select("doc_id", T.marginal_key(F.col("line")).alias("key")).where("key <> ''")
    return k.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS size FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


# ---- page ranges and intervals

@query("""SELECT o_orderkey, list_sort(list_distinct(list_concat(range(o_orderkey % 7, o_orderkey % 7 + 3), range(o_orderkey % 11, o_orderkey % 11 + 2)))) AS pages FROM orders""")
def page_range_expand(spark, d):
    o = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    raw = F.concat(text(o % 7 + 1), F.lit("-"), text(o % 7 + 3), F.lit(", "), F.lit("r"), text(20 - o % 11), F.lit("-"), text(o % 11 + 2))
    return table(spark, d, "orders").select("o_orderkey", F.transform(numbers.page_range(raw, F.lit(20)), lambda p: p.cast("long")).alias("pages"))


@query("""SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ',' ORDER BY lo) AS pages FROM
 (SELECT o_custkey, min(p) AS lo, max(p) AS hi FROM (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS g FROM (SELECT DISTINCT o_custkey, o_orderkey % 40 AS p FROM orders)) GROUP BY o_custkey, g) GROUP BY o_custkey""")
def page_range_format(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 40)).alias("p"))
    return g.select("o_custkey", numbers.format_pages(F.col("p")).alias("pages"))


@query("""SELECT o_custkey, min(p) AS lo, max(p) AS hi, count(*) AS n FROM (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS g FROM (SELECT DISTINCT o_custkey, o_orderkey % 40 AS p FROM orders)) GROUP BY o_custkey, g""")
def page_range_islands(spark, d):
    return relational.islands(table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("p")), ["o_custkey"], "p")


@query(f"""SELECT doc, min(x0) AS lo, max(x1) AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM
 (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY doc ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({BOXES_SQL}) b)) GROUP BY doc, run""")
def interval_union(spark, d):
    return relational.merged_intervals(boxes(spark, d).select("doc", "b.x0", "b.x1"), ["doc"], "x0", "x1")


@query("SELECT o_orderkey, CASE WHEN n <= 10 THEN range(0, n) ELSE list_sort(list_concat(s, list_filter(range(0, n), lambda x: NOT list_contains(s, x))[1:10 - len(s)])) END AS pages FROM (SELECT o_orderkey, n, list_distinct(list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9, 0) AS BIGINT))) AS s FROM (SELECT o_orderkey, o_orderkey % 37 AS n FROM orders))")
def sample_pages(spark, d):
    n = (F.col("o_orderkey") % 37).cast("int")
    return table(spark, d, "orders").select("o_orderkey", F.transform(numbers.sample_pages(n), lambda p: p.cast("long")).alias("pages"))


# ---- boxes

@query(f"""SELECT a.doc, a.idx AS i, b.idx AS j, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common,
 round(sqrt(pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2)), 6) AS gap FROM ({BOXES_SQL}) a JOIN ({BOXES_SQL}) b ON a.doc = b.doc AND b.idx = a.idx + 1""")
def bbox_overlap(spark, d):
    a, b = boxes(spark, d).select("doc", F.col("idx").alias("i"), F.col("b").alias("p")), boxes(spark, d).select("doc", F.col("idx").alias("j"), F.col("b").alias("q"))
    j = a.join(b, "doc").where("j = i + 1")
    return j.select("doc", "i", "j", bbox.overlap(F.col("p"), F.col("q")).alias("common"), F.round(bbox.gap(F.col("p"), F.col("q")), 6).alias("gap"))


@query(f"""SELECT doc, idx, CASE idx % 4 WHEN 0 THEN x0 WHEN 1 THEN 1000 - y1 WHEN 2 THEN 800 - x1 ELSE y0 END AS rx0, CASE idx % 4 WHEN 0 THEN y0 WHEN 1 THEN x0 WHEN 2 THEN 1000 - y1 ELSE 800 - x1 END AS ry0, (x1 - x0) * (y1 - y0) AS area FROM ({BOXES_SQL}) b""")
def bbox_rotate(spark, d):
    b = boxes(spark, d)
    r = bbox.rotate(F.col("b"), F.lit(800.0), F.lit(1000.0), (F.col("idx") % 4) * 90)
    return b.withColumn("r", r).select("doc", "idx", F.col("r.x0").alias("rx0"), F.col("r.y0").alias("ry0"), bbox.area(F.col("r")).alias("area"))


@query(f"""SELECT doc, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM ({BOXES_SQL}) b GROUP BY doc""")
def bbox_union(spark, d):
    g = boxes(spark, d).groupBy("doc").agg(bbox.union(F.col("b")).alias("u"), F.count(F.lit(1)).alias("n"))
    return g.select("doc", "u.x0", "u.y0", "u.x1", "u.y1", "n")


@query(f"""SELECT doc, idx, CAST(round_even(x0 / 1024 * 1000, 0) AS INTEGER) AS x0, CAST(round_even(y1 / 1024 * 1000, 0) AS INTEGER) AS y1 FROM ({BOXES_SQL}) b WHERE x1 <= 1024 AND y1 <= 1024""")
def bbox_per_mille(spark, d):
    b = boxes(spark, d)
    share = bbox.convert(F.col("b"), F.lit(1024.0), F.lit(1024.0), "share")
    return b.withColumn("m", bbox.per_mille(share)).where("m is not null").select("doc", "idx", "m.x0", "m.y1")


@query(f"""SELECT DISTINCT a.doc, a.idx AS i, b.idx AS j FROM ({BOXES_SQL}) a JOIN ({BOXES_SQL}) b ON a.doc = b.doc AND a.idx < b.idx AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def interval_candidates(spark, d):
    a = boxes(spark, d).select("doc", F.col("idx").alias("i"), F.col("b.y0").alias("a0"), F.col("b.y1").alias("a1"))
    b = boxes(spark, d).select("doc", F.col("idx").alias("j"), F.col("b.y0").alias("b0"), F.col("b.y1").alias("b1"))
    return relational.interval_join(a, b, ["doc"], ("a0", "a1"), ("b0", "b1"), 50.0).where("i < j").select("doc", "i", "j").distinct()


@query(f"""SELECT DISTINCT p.doc, p.idx AS i, b.idx AS j FROM ({BOXES_SQL}) p JOIN ({BOXES_SQL}) b ON p.doc = b.doc AND p.idx <> b.idx AND (p.x0 + p.x1) / 2 BETWEEN b.x0 AND b.x1""")
def point_in_interval(spark, d):
    p = boxes(spark, d).select("doc", F.col("idx").alias("i"), bbox.centre(F.col("b"))["x"].alias("x"))
    r = boxes(spark, d).select("doc", F.col("idx").alias("j"), F.col("b.x0").alias("lo"), F.col("b.x1").alias("hi"))
    return relational.point_in_range(p, r, ["doc"], "x", "lo", "hi", 40.0).where("i <> j").select("doc", "i", "j").distinct()


@query(f"""SELECT doc, child, parent, round(distance, 6) AS distance FROM (SELECT c.doc, c.idx AS child, p.idx AS parent, sqrt(pow(greatest(p.x0 - c.x1, c.x0 - p.x1, 0), 2) + pow(greatest(p.y0 - c.y1, c.y0 - p.y1, 0), 2)) AS distance,
 row_number() OVER (PARTITION BY c.doc, c.idx ORDER BY sqrt(pow(greatest(p.x0 - c.x1, c.x0 - p.x1, 0), 2) + pow(greatest(p.y0 - c.y1, c.y0 - p.y1, 0), 2)), p.idx) AS rn
 FROM (SELECT doc, idx, max(x0) AS x0, max(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({BOXES_SQL}) GROUP BY ALL) c JOIN (SELECT doc, idx, max(x0) AS x0, max(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({BOXES_SQL}) GROUP BY ALL) p ON c.doc = p.doc AND c.idx % 2 = 0 AND p.idx % 2 = 1) WHERE rn = 1""")
def nearest_parent(spark, d):
    one = boxes(spark, d).groupBy("doc", "idx").agg(*[F.max(f"b.{s}").alias(s) for s in bbox.SIDES]).select("doc", "idx", F.struct(*bbox.SIDES).alias("b"))
    c = one.where("idx % 2 = 0").select("doc", F.col("idx").alias("child"), F.col("b").alias("child_box"))
    p = one.where("idx % 2 = 1").select("doc", F.col("idx").alias("parent"), F.col("b").alias("parent_box"))
    return layout.nearest_parents(c, p, ["doc"]).select("doc", "child", "parent", F.round("distance", 6).alias("distance"))


@query(f"""SELECT doc, child, min(parent) AS parent FROM (SELECT c.doc, c.idx AS child, p.idx AS parent FROM ({BOXES_SQL}) c JOIN ({BOXES_SQL}) p ON c.doc = p.doc AND c.idx % 2 = 0 AND p.idx % 2 = 1
 WHERE greatest(0, least(c.x1, p.x1 + 200) - greatest(c.x0, p.x0 - 200)) * greatest(0, least(c.y1, p.y1 + 100) - greatest(c.y0, p.y0 - 100)) / ((c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.8) GROUP BY doc, child""")
def text_in_list(spark, d):
    b = F.col("b")
    c = boxes(spark, d).where("idx % 2 = 0").select("doc", F.col("idx").alias("child"), b.alias("child_box"))
    wide = bbox.box(b["x0"] - 200, b["y0"] - 100, b["x1"] + 200, b["y1"] + 100)
    p = boxes(spark, d).where("idx % 2 = 1").select("doc", F.col("idx").alias("parent"), wide.alias("parent_box"))
    return layout.contained(c, p, ["doc"])


@query()
def reading_order(spark, d):
    b = boxes(spark, d).select("doc", "idx", "b.*")
    return layout.reading_order(b, ["doc"]).select("doc", "idx", "x0", "y0", "position")


# ---- order-dependent rules

@query("""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user FROM
 (SELECT *, coalesce(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM conversations)""")
def paragraph_barrier_lookup(spark, d):
    c = table(spark, d, "conversations")
    return relational.last_behind_barrier(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "system", F.col("turn"), "prev_user").select("conv_id", "turn", "prev_user")


@query("""SELECT conv_id, min(turn) AS first, max(turn) AS last, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT *, sum(CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations) GROUP BY conv_id, g""")
def continuation_groups(spark, d):
    c = table(spark, d, "conversations").withColumn("continues_prev", F.col("turn") % 3 == 2)
    return layout.logical_blocks(c, "conv_id", "turn")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + CAST(user_id % 3 AS INTEGER) - 1 AS number FROM events""")
def list_numbering(spark, d):
    e = table(spark, d, "events").withColumn("start", F.col("user_id") % 3)
    return layout.list_numbers(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("start")).select("user_id", "event_id", "number")


@query("""WITH h AS (SELECT user_id, event_id, CAST(event_id % 3 + 1 AS INTEGER) AS level FROM events), a AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n1 FROM h),
 b AS (SELECT *, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, n1 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n2 FROM a), c AS (SELECT *, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, n1, n2 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n3 FROM b)
 SELECT user_id, event_id, CASE level WHEN 1 THEN CAST(n1 AS VARCHAR) WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS number FROM c""")
def heading_numbering(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("level"))
    return layout.heading_numbers(e, "user_id", "event_id", "level", 3).select("user_id", "event_id", "number")


@query("""SELECT user_id, CAST(coalesce(max(n), 0) AS BIGINT) AS longest FROM (SELECT user_id, g, sum(CASE WHEN f THEN 1 ELSE 0 END) AS n FROM (SELECT user_id, f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g
 FROM (SELECT user_id, event_id, value < 10 AS f FROM events)) GROUP BY ALL) GROUP BY user_id""")
def longest_true_run(spark, d):
    return relational.longest_run(table(spark, d, "events"), ["user_id"], "event_id", F.col("value") < 10)


@query("""SELECT l.event_id, r.event_id AS event_id_asof, r.value AS value_asof FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_neighbor(spark, d):
    e = table(spark, d, "events")
    l, r = e.where("event_type = 'purchase'"), e.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return relational.asof(l, r, ["user_id"], "ts", "ts", ["event_id", "value"]).select("event_id", "event_id_asof", "value_asof")


@query("""SELECT a.conv_id, b.conv_id AS other, a.turn FROM conversations a JOIN conversations b ON b.conv_id - a.conv_id BETWEEN 1 AND 2 AND a.turn = b.turn AND a.role = b.role WHERE length(a.text) % 5 = length(b.text) % 5""")
def marginal_pairs_within2(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.length("text") % 5).alias("k"))
    return relational.later_within(c, ["turn", "role", "k"], "conv_id", 2, "other").select("conv_id", "other", "turn")


# ---- profiles, quantiles, clusters, choices

@query("SELECT lang, median(n_chars) AS med, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.9) AS p90, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang")
def median_profile(spark, d):
    docs = table(spark, d, "documents")
    ends = docs.groupBy("lang").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    return relational.linear_quantiles(docs, ["lang"], "n_chars", {"med": 0.5, "q1": 0.25, "p90": 0.9}).join(ends, "lang")


@query("SELECT lang, xs[CAST(round_even((len(xs) - 1) * 0.75, 0) AS INTEGER) + 1] AS q FROM (SELECT lang, list_sort(list(n_chars)) AS xs FROM documents GROUP BY lang)")
def nearest_quantile(spark, d):
    return relational.quantile(table(spark, d, "documents"), ["lang"], "n_chars", 0.75, "q")


@query("SELECT l_returnflag, l_linestatus, mode, weight FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY weight DESC, mode) AS rn FROM (SELECT l_returnflag, l_linestatus, l_linenumber AS mode, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL)) WHERE rn = 1")
def weighted_mode(spark, d):
    return relational.weighted_mode(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", F.col("l_quantity"))


@query("SELECT p_type, mode, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, mode DESC) AS rn FROM (SELECT p_type, p_size AS mode, count(*) AS n FROM part GROUP BY ALL)) WHERE rn = 1")
def mode_by_group(spark, d):
    c = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("p_type").agg(F.max(F.struct("n", "p_size")).alias("m")).select("p_type", F.col("m.p_size").alias("mode"), F.col("m.n").alias("n"))


@query()
def ordered_clusters_1d(spark, d):
    p = table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice")
    return layout.clusters(p, ["p_type"], "p_retailprice", 5.0).groupBy("p_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3""")
def top_k_per_group(spark, d):
    li = table(spark, d, "lineitem")
    return relational.top_k(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")], 3).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_quantity >= 10)
 SELECT b.l_orderkey, b.l_linenumber, b.l_quantity FROM c b WHERE b.rn = 1 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.l_orderkey = b.l_orderkey AND o.l_returnflag <> b.l_returnflag AND b.l_quantity - o.l_quantity < 5)""")
def top1_with_gap_veto(spark, d):
    li = table(spark, d, "lineitem")
    return relational.best_with_veto(li, ["l_orderkey"], "l_quantity", "l_returnflag", 10, 5, [F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT a.c_nationkey, a.a, a.b FROM (SELECT c_nationkey, a, b FROM (SELECT c_nationkey, a, b, row_number() OVER (PARTITION BY c_nationkey, a ORDER BY dist, b) AS rn FROM e) WHERE rn = 1) a JOIN (SELECT c_nationkey, a, b FROM (SELECT c_nationkey, a, b, row_number() OVER (PARTITION BY c_nationkey, b ORDER BY dist, a) AS rn FROM e) WHERE rn = 1) b USING (c_nationkey, a, b)""".replace("FROM e)", "FROM (SELECT c_nationkey, c_custkey AS a, s_suppkey AS b, abs(c_acctbal - s_acctbal) AS dist FROM customer JOIN supplier ON c_nationkey = s_nationkey))"))
def mutual_nearest(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("a"), F.col("c_acctbal").alias("x"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("y"))
    return relational.mutual_nearest_values(c, s, ["c_nationkey"], ("a", "x"), ("b", "y"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS u, c_custkey + 7 AS v FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey + 7 IN (SELECT c_custkey FROM customer)), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
 r AS (SELECT u AS node, u AS c FROM b UNION SELECT b.v, r.c FROM r JOIN b ON r.node = b.u WHERE r.c < b.v) SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(spark, d):
    c = table(spark, d, "customer")
    there = c.select(F.col("c_custkey").alias("v"))
    e = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") + 7).alias("v")).join(there, "v", "left_semi")
    return connected_components(e, "u", "v")


# ---- tables

@query("SELECT n_regionkey, '<table>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY n_regionkey")
def grid_cells_html(spark, d):
    return tables.to_html(_nation_cells(spark, d), ["n_regionkey"])


@query("SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |' || CASE WHEN rn = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY n_nationkey) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY n_regionkey")
def grid_markdown(spark, d):
    return tables.to_markdown(_nation_cells(spark, d), ["n_regionkey"])


def _nation_cells(spark, d) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = table(spark, d, "nation").withColumn("row", F.row_number().over(w) - 1)
    return n.select("n_regionkey", "row", F.posexplode(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("col", "value"))


@query("SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, coalesce(n_name, '') AS value FROM unnest(range(0, 5)) a(r) CROSS JOIN unnest(range(0, 5)) b(c) LEFT JOIN nation ON n_regionkey = r AND n_nationkey // 5 = c AND n_nationkey % 3 <> 0 WHERE r <= (SELECT max(n_regionkey) FROM nation WHERE n_nationkey % 3 <> 0) AND c <= (SELECT max(n_nationkey // 5) FROM nation WHERE n_nationkey % 3 <> 0)")
def grid_pad(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 3 <> 0")
    cells = n.select(F.lit(1).alias("k"), F.col("n_regionkey").alias("row"), F.expr("int(n_nationkey div 5)").alias("col"), F.col("n_name").alias("value"))
    return tables.padded(cells, ["k"]).select("row", "col", "value")


@query("""SELECT o_orderpriority, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS BIGINT) AS F, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0) AS BIGINT) AS O, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0) AS BIGINT) AS P FROM orders GROUP BY 1""")
def pivot_chart_table(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""SELECT event_type, count(*) AS n, CASE WHEN sum(CASE WHEN regexp_matches(v, '^-?[0-9.]+$') THEN 1 ELSE 0 END) >= 0.9 * count(*) THEN 'number' WHEN sum(CASE WHEN lower(v) IN ('yes', 'no', 'true', 'false') THEN 1 ELSE 0 END) >= 0.9 * count(*) THEN 'boolean'
 WHEN sum(CASE WHEN regexp_matches(v, '^\\d{4}-') THEN 1 ELSE 0 END) >= 0.9 * count(*) THEN 'date' WHEN sum(CASE WHEN v = 'abc' THEN 1 ELSE 0 END) >= 0.9 * count(*) THEN 'text' END AS kind FROM
 (SELECT event_type, CASE event_type WHEN 'view' THEN CAST(event_id AS VARCHAR) WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END WHEN 'error' THEN '2024-01-' || (event_id % 28 + 1) WHEN 'signup' THEN 'abc' ELSE CASE WHEN event_id % 2 = 0 THEN 'abc' ELSE '7' END END AS v FROM events) GROUP BY event_type""".replace("\\\\d", "\\d"))
def csv_kind_vote(spark, d):
    i = F.col("event_id")
    t = F.col("event_type")
    v = F.when(t == "view", i.cast("string")).when(t == "click", F.when(i % 2 == 0, "Yes").otherwise("no")).when(t == "error", F.concat(F.lit("2024-01-"), (i % 28 + 1).cast("string"))).when(t == "signup", "abc").otherwise(F.when(i % 2 == 0, "abc").otherwise("7"))
    return tables.dominant_kinds(table(spark, d, "events").select("event_type", v.alias("v")), ["event_type"], "v")


@query(r"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS row FROM part), k AS (SELECT p_type, avg(CASE WHEN regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$') THEN 1.0 ELSE 0 END) >= 0.9 AS size_typed, avg(CASE WHEN regexp_matches(p_name, '^[0-9]+$') THEN 1.0 ELSE 0 END) >= 0.9 AS name_typed,
 max(CASE WHEN lower(p_name) = 'red ring' THEN 1 ELSE 0 END) = 1 AS again, CASE WHEN p_type < 'M' THEN 'Size' ELSE '12' END AS label FROM p WHERE row <= 50 GROUP BY p_type),
 v AS (SELECT p_type, CAST(CASE WHEN size_typed AND label = 'Size' THEN 1 ELSE 0 END AS INTEGER) AS header_votes, CAST(CASE WHEN size_typed AND label <> 'Size' THEN 1 ELSE 0 END + CASE WHEN NOT name_typed AND again THEN 1 ELSE 0 END AS INTEGER) AS data_votes FROM k)
 SELECT *, CASE WHEN header_votes > 0 OR data_votes > 0 THEN header_votes > data_votes ELSE TRUE END AS has_header FROM v""")
def header_vote(spark, d):
    w = Window.partitionBy("p_type").orderBy("p_partkey")
    p = table(spark, d, "part").withColumn("row", F.row_number().over(w)).where("row <= 50")  # what the vote looks at
    body = p.select("p_type", "row", F.posexplode(F.array(F.col("p_name"), F.col("p_size").cast("string"))).alias("col", "value"))
    label = F.when(F.col("p_type") < "M", "Size").otherwise("12")
    head = p.select("p_type").distinct().select("p_type", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Red ring"), label)).alias("col", "value"))
    v = tables.header_votes(head.unionByName(body), ["p_type"])
    return v.select("p_type", F.col("header_votes").cast("int").alias("header_votes"), F.col("data_votes").cast("int").alias("data_votes"), "has_header")


@query()
def region_boundaries(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("sheet"), (F.col("p_partkey") * 37 % 97).cast("int").alias("row"), (F.col("p_size") % 30).cast("int").alias("col"))
    return tables.regions(p, ["sheet"], 1)


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS m FROM lineitem GROUP BY ALL) SELECT a.l_suppkey, a.l_orderkey, len(a.m) AS n FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.l_suppkey = b.l_suppkey AND len(a.m) < len(b.m) AND list_has_all(b.m, a.m))""")
def subset_elimination(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("m"))
    return relational.maximal_sets(s, ["l_suppkey"], "l_orderkey", "m").select("l_suppkey", "l_orderkey", F.size("m").cast("long").alias("n"))


@query("""SELECT o_orderkey, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, min(k) AS owner FROM (SELECT o_orderkey, k, unnest(range(k % 3, k % 3 + 1 + k % 2)) AS r FROM (SELECT o_orderkey, unnest(range(0, 4)) AS k FROM orders)), unnest(range(k, k + 1 + k % 3)) u(c) GROUP BY o_orderkey, r, c""")
def occupied_matrix(spark, d):
    k = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    cells = k.select("o_orderkey", (F.col("k") % 3).alias("row"), F.col("k").alias("col"), (1 + F.col("k") % 2).alias("rowspan"), (1 + F.col("k") % 3).alias("colspan"), F.col("k").cast("long").alias("cell"))
    return tables.occupied(cells, ["o_orderkey"])


@query("""WITH b AS (SELECT conv_id, turn // 2 AS page, turn AS idx, CASE role WHEN 'assistant' THEN 'table' WHEN 'system' THEN 'header' ELSE CASE WHEN turn % 4 = 0 THEN 'table' ELSE 'text' END END AS type FROM conversations), m AS (SELECT * FROM b WHERE type <> 'header'),
 e AS (SELECT conv_id, page, arg_min(type, idx) AS a, min(idx) AS ai, arg_max(type, idx) AS z, max(idx) AS zi FROM m GROUP BY ALL) SELECT p.conv_id, p.page AS prev_page, p.zi AS prev_idx, c.ai AS idx FROM e p JOIN e c ON p.conv_id = c.conv_id AND c.page = p.page + 1 WHERE p.z = 'table' AND c.a = 'table'""")
def cross_page_table_pairs(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "assistant", "table").when(F.col("role") == "system", "header").when(F.col("turn") % 4 == 0, "table").otherwise("text")
    b = c.select("conv_id", F.expr("turn div 2").alias("page"), F.col("turn").alias("idx"), kind.alias("type"))
    return tables.boundary_tables(b, "conv_id", "page", "idx")


# ---- sets, JSON, spans

@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_claimed(spark, d):
    return relational.without(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def union_claimed(spark, d):
    return relational.distinct_union([table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id"))])


@query("SELECT o_orderkey, list_filter(['bold', 'italic', 'underline'], lambda s: list_contains(CASE o_orderkey % 4 WHEN 0 THEN ['italic', 'bold'] WHEN 1 THEN ['underline', 'blink'] WHEN 2 THEN ['bold', 'bold'] ELSE ['x'] END, s)) AS styles FROM orders")
def intersect_styles(spark, d):
    o = F.col("o_orderkey") % 4
    arr = lambda *v: F.array(*map(F.lit, v))
    raw = F.when(o == 0, arr("italic", "bold")).when(o == 1, arr("underline", "blink")).when(o == 2, arr("bold", "bold")).otherwise(arr("x"))
    return table(spark, d, "orders").select("o_orderkey", spans.styles(raw).alias("styles"))


@query("SELECT doc_id, t AS plain, substr(t, greatest(m - 5, 0) + 1, m + 5 - greatest(m - 5, 0)) AS cut, CASE WHEN t = '' THEN 0 ELSE 1 END AS n_same FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS m FROM documents)")
def span_algebra(spark, d):
    none = F.array().cast("array<string>")
    middle = F.coalesce(F.expr("length(text) div 2"), F.lit(0)).cast("int")
    part = lambda a, n: spans.span(F.lit("text"), F.substr("text", a, n), none, F.lit(None).cast("string"))
    s = table(spark, d, "documents").withColumn("m", middle).withColumn("s", F.array(part(F.lit(1), F.col("m")), part(F.col("m") + 1, F.length("text"))))
    cut = spans.cut(F.col("s"), F.greatest(F.col("m") - 5, F.lit(0)), F.col("m") + 5)
    return s.select("doc_id", spans.plain(F.col("s")).alias("plain"), spans.plain(cut).alias("cut"), F.size(spans.normalise(F.col("s"))).alias("n_same"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_roundtrip(spark, d):
    return table(spark, d, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


# ---- dates and numbers

@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM orders""")
def date_precision_iso(spark, d):
    o, t = F.col("o_orderkey") % 3, F.col("o_orderdate")
    raw = F.when(o == 0, F.date_format(t, "'D:'yyyy")).when(o == 1, F.date_format(t, "'D:'yyyyMMdd")).otherwise(F.date_format(t, "'D:'yyyyMMddHHmmss'Z'"))
    return table(spark, d, "orders").select("o_orderkey", numbers.property_date(raw).alias("iso"))


@query("""SELECT o_orderkey, CASE WHEN n = 60 THEN NULL ELSE strftime(DATE '1899-12-31' + CAST(CASE WHEN n > 60 THEN n - 1 ELSE n END AS INTEGER), '%Y-%m-%d') END AS day, strftime(DATE '1904-01-01' + CAST(n AS INTEGER), '%Y-%m-%d') AS day1904 FROM (SELECT o_orderkey, o_orderkey % 50000 AS n FROM orders)""")
def excel_serial_date(spark, d):
    n = (F.col("o_orderkey") % 50000).cast("double")
    return table(spark, d, "orders").select("o_orderkey", numbers.serial_date(n).alias("day"), numbers.serial_date(n, True).alias("day1904"))


@query("SELECT o_orderkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.10f', x), '0'), '.') END AS shown FROM (SELECT o_orderkey, o_orderkey / 8.0 AS x FROM (SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders))".replace("SELECT o_orderkey, o_orderkey / 8.0 AS x FROM (SELECT o_orderkey::DOUBLE AS o_orderkey FROM orders)", "SELECT o_orderkey, o_orderkey::DOUBLE / 8 AS x FROM orders"))
def office_general_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", numbers.general(F.col("o_orderkey").cast("double") / 8).alias("shown"))


# ---- events as they come

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return ingest.tumbling(table(spark, d, "events"))


@query("SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS start FROM events, unnest(range(0, 2)) u(k)) GROUP BY 1")
def sliding_counts(spark, d):
    return ingest.sliding(table(spark, d, "events"))


@query("""SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def session_counts(spark, d):
    return ingest.sessions(table(spark, d, "events"))


# ---- content, pictures, formats

@query()
def html_main_content(spark, d):
    from foliant.sources.main_content import main_content

    return main_content(table(spark, d, "pages"))


@query()
def html_metadata(spark, d):
    from foliant.sources.metadata import read_metadata

    p = table(spark, d, "pages")
    return read_metadata(p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")))


@query()
def parse_files(spark, d):
    """Every page as an HTML file and every order as a row of its customer's CSV file through the same reader."""
    from foliant.sources.packages import read_documents

    p = table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    o = table(spark, d, "orders")
    c = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(";", *o.columns))), "\n").alias("t"))
    c = c.select(F.concat(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), F.col("t").cast("binary").alias("content"))
    return read_documents(p.unionByName(c)).groupBy("suffix", "type").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS money, format('{:.0f}%', (o_orderkey % 7) * 100.0) AS percent, strftime(DATE '1899-12-30' + CAST(o_orderkey % 9000 + 100 AS INTEGER), '%Y/%m/%d') AS day FROM orders")
def number_formats(spark, d):
    from foliant.functions.formats import formatted

    o = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", formatted(F.col("o_totalprice"), F.lit("#,##0.00")).alias("money"), formatted(o % 7, F.lit("0%")).alias("percent"), formatted(o % 9000 + 100, F.lit("yyyy/mm/dd")).alias("day"))


@query(f"""WITH b AS (SELECT doc, idx, CASE idx % 4 WHEN 1 THEN 'caption' WHEN 2 THEN 'table' WHEN 3 THEN 'footnote' ELSE 'text' END AS type FROM ({BOXES_SQL}) x GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx) AS pos FROM b)
 SELECT doc, child, parent FROM (SELECT c.doc, c.idx AS child, t.idx AS parent, row_number() OVER (PARTITION BY c.doc, c.idx ORDER BY abs(t.pos - c.pos), CASE WHEN c.type = 'caption' THEN -t.pos ELSE t.pos END) AS rn FROM p c JOIN p t ON c.doc = t.doc AND t.type = 'table'
 AND c.type IN ('caption', 'footnote') AND (c.type = 'caption' OR t.pos < c.pos) WHERE NOT EXISTS (SELECT 1 FROM p u WHERE u.doc = c.doc AND u.pos > least(c.pos, t.pos) AND u.pos < greatest(c.pos, t.pos) AND NOT (u.type = 'caption' OR (c.type = 'footnote' AND u.type = 'footnote')))) WHERE rn = 1""")
def caption_parents(spark, d):
    from foliant.operators.visual import caption_parents as parents
    from foliant.plans.shared import dealt

    one = dealt(boxes(spark, d).select("doc", "idx"), ["doc"]).groupBy("doc", "idx").agg(F.struct(*[F.lit(v).cast("double").alias(s) for v, s in zip((0, 0, 1, 1), bbox.SIDES)]).alias("b"))
    i = F.col("idx") % 4
    kind = F.when(i == 1, "caption").when(i == 2, "table").when(i == 3, "footnote").otherwise("text")
    return parents(one.withColumn("type", kind), ["doc"], placed=True)


@query("""WITH a AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, n_name AS value FROM nation) SELECT k, CAST(0 AS INTEGER) AS row, 'Name' AS value FROM region, (SELECT r_regionkey AS k FROM region) z WHERE r_regionkey = 0
 UNION ALL SELECT k, CAST(row AS INTEGER), value FROM a UNION ALL SELECT k, CAST(row + (SELECT count(*) FROM a b WHERE b.k = a.k) AS INTEGER), lower(value) FROM a""")
def table_merge(spark, d):
    w = Window.partitionBy("k").orderBy("n_nationkey")
    n = table(spark, d, "nation").withColumn("k", F.col("n_regionkey")).withColumn("row", F.row_number().over(w))
    head = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.lit(0).alias("row"), F.lit("Name").alias("value"))
    first = head.unionByName(n.select("k", "row", F.col("n_name").alias("value"))).withColumn("col", F.lit(0))
    second = head.unionByName(n.select("k", "row", F.lower("n_name").alias("value"))).withColumn("col", F.lit(0))
    rows = lambda t, side: t.groupBy("k", "row").agg(F.collect_list("value").alias("cells")).withColumn("side", F.lit(side))
    shared = tables.header_rows(rows(first, 0).unionByName(rows(second, 1)), ["k"])
    return tables.merged(first, second, ["k"], shared).select("k", "row", "value")


@query(r"""SELECT doc, CASE WHEN reason IS NULL THEN 'text' ELSE 'ocr' END AS verdict, reason FROM (SELECT doc, CASE WHEN max(greatest(w / h, h / w)) > 10 THEN 'aspect' WHEN sum(n) < 50 * count(*) THEN 'few characters'
 WHEN sum(odd) >= 0.04 * sum(n) THEN 'broken encoding' WHEN sum(CASE WHEN imgs > 0 AND n < 50 THEN 1 ELSE 0 END) > count(*) / 2 THEN 'pictures of pages' END AS reason FROM (SELECT doc_id % 97 AS doc, 600.0 AS w, CASE WHEN doc_id % 97 = 5 THEN 30.0 ELSE 800.0 END AS h, doc_id % 2 AS imgs,
 length(t) AS n, length(t) - length(regexp_replace(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08]', '', 'g')) AS odd FROM (SELECT *, CASE WHEN doc_id % 97 = 3 THEN 'x' ELSE text END AS t FROM documents)) GROUP BY doc)""")
def text_or_ocr(spark, d):
    from foliant.sources.fixed_layout import text_or_ocr as verdicts

    i = F.col("doc_id")
    p = table(spark, d, "documents").select((i % 97).alias("doc"), F.lit(600.0).alias("width"), F.when(i % 97 == 5, 30.0).otherwise(800.0).alias("height"), F.when(i % 97 == 3, "x").otherwise(F.col("text")).alias("text"), (i % 2).alias("n_images"))
    return verdicts(p, "doc")


@query()
def chars_to_lines(spark, d):
    """Names set as characters of ten points, two a page, and read back as lines."""
    from foliant.sources.fixed_layout import distinct_glyphs, lines_of

    n = table(spark, d, "nation").select((F.col("n_nationkey") % 5).alias("page_idx"), (F.col("n_nationkey") * 20.0).alias("y"), F.posexplode(F.split("n_name", "")).alias("i", "char")).where("char <> ''")
    c = n.select("page_idx", (F.col("y") * 100 + F.col("i")).cast("int").alias("char_idx"), "char", (F.col("i") * 5.0).alias("x0"), F.col("y").alias("y0"), (F.col("i") * 5.0 + 5).alias("x1"), (F.col("y") + 10).alias("y1"), F.lit(10.0).alias("size"))
    twice = c.unionByName(c.withColumn("char_idx", F.col("char_idx") + 1_000_000).withColumn("x0", F.col("x0") + 0.1))
    return lines_of(distinct_glyphs(twice, ["page_idx"]), ["page_idx"])


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def bundle_round_trip(spark, d):
    from foliant.plans.shared import shared_path

    path = shared_path(spark, "bundle")
    n = table(spark, d, "nation").withColumn("json", F.to_json(F.struct("n_regionkey", "n_nationkey", "n_name")))
    render.write_bundle(n, path, "n_nationkey", "json")
    j = F.from_json(F.col("content").cast("string"), "n_regionkey int, n_nationkey int, n_name string")
    return render.load_bundle(spark, path).select(j.alias("j")).select("j.*")
