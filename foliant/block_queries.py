"""Registered queries of the block rules, on tables that stand for blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import blocks as B
from foliant.queries import query, table

#: Events as a document's blocks: one document a user.
BLOCK = """user_id AS doc, CAST(floor(event_id / 50) AS BIGINT) AS page, event_id AS idx, CASE event_id % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'ref_text' WHEN 3 THEN 'list' WHEN 4 THEN 'header' WHEN 5 THEN 'table' ELSE 'doc_title' END AS type, CAST(event_id % 9 AS INTEGER) AS level, event_id % 4 = 0 AS flag"""
E = f"WITH b AS (SELECT {BLOCK} FROM events)"


def blocks(spark, d) -> DataFrame:
    return spark.sql(f"SELECT {BLOCK} FROM {{t}}", t=table(spark, d, "events"))


@query(E + """ SELECT doc, page, idx, CASE type WHEN 'title' THEN 'paragraph_title' ELSE type END AS type, CAST(CASE type WHEN 'title' THEN greatest(2, least(6, level)) WHEN 'doc_title' THEN 1 END AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY idx) - 1 AS INTEGER) AS "index" FROM b""")
def raw_blocks(spark, d):
    return B.raw_blocks(blocks(spark, d), ["doc", "page"], "idx").select("doc", "page", "idx", "type", "level", "index")


@query(E + " SELECT doc, idx, CASE WHEN type IN ('text', 'ref_text', 'list', 'index') THEN type ELSE 'other' END AS role FROM b")
def text_partition(spark, d):
    return B.by_role(blocks(spark, d)).select("doc", "idx", "role")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS child, line AS text FROM (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)) WHERE trim(line) <> ''")
def index_lines(spark, d):
    return B.index_lines(table(spark, d, "documents").select("doc_id", "text"))


@query("""SELECT o_orderkey AS doc, CAST(o_custkey % 5 AS VARCHAR) AS path, 'table' AS type, 0::DOUBLE AS x0, 0::DOUBLE AS y0, CAST(o_totalprice AS DOUBLE) AS x1, 9::DOUBLE AS y1 FROM orders
 UNION ALL SELECT o_orderkey, (o_custkey % 5) || '.' || k, CASE k WHEN 0 THEN 'caption' ELSE 'body' END, CAST(k AS DOUBLE), 1::DOUBLE, 5::DOUBLE, 6::DOUBLE FROM orders, range(0, 2) r(k)""")
def layout_regions(spark, d):
    child = lambda k, name: F.struct(F.lit(name).alias("type"), F.lit(float(k)).alias("x0"), F.lit(1.0).alias("y0"), F.lit(5.0).alias("x1"), F.lit(6.0).alias("y1"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 5).alias("idx"), F.lit("table").alias("type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("o_totalprice").alias("x1"), F.lit(9.0).alias("y1"), F.array(child(0, "caption"), child(1, "body")).alias("children"))
    return B.layout_regions(o, ["doc"], "children")


PAINT = """WITH t AS (SELECT CAST(floor(o_orderkey / 20) AS BIGINT) AS page, o_orderkey AS idx, o_custkey % 10 AS z, CAST(o_custkey % 37 * 9 AS DOUBLE) AS x0, CAST(o_custkey % 37 * 9 + 20 AS DOUBLE) AS x1, CAST(o_custkey % 11 * 9 AS DOUBLE) AS y0, CAST(o_custkey % 11 * 9 + 10 AS DOUBLE) AS y1 FROM orders)"""


@query(PAINT + " SELECT page, idx FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.page = t.page AND p.idx % 3 = 0 AND p.z > t.z AND p.x0 - 60 <= t.x0 AND p.y0 - 60 <= t.y0 AND p.x1 + 60 >= t.x1 AND p.y1 + 60 >= t.y1)")
def painted_over(spark, d):
    t = spark.sql(PAINT.replace("FROM orders)", "FROM {t})") + " SELECT * FROM t", t=table(spark, d, "orders"))
    p = t.where("idx % 3 = 0").selectExpr("page", "x0 - 60 AS px0", "y0 - 60 AS py0", "x1 + 60 AS px1", "y1 + 60 AS py1", "z AS pz")
    return B.not_painted_over(t, p, ["page"]).select("page", "idx")


@query("SELECT event_id FROM events WHERE (event_id * 7 % 360) % 90 <= 5 OR (event_id * 7 % 360) % 90 >= 85")
def upright_runs(spark, d):
    return B.upright(table(spark, d, "events").withColumn("angle", (F.col("event_id") * 7 % 360).cast("double")), "angle").select("event_id")


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN url_ END AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://h.org/a?b=1' WHEN 1 THEN 'HTTPS://h.org' WHEN 2 THEN 'https://me@h.org/x' ELSE 'ftp://h.org/x' END AS url_ FROM pages)")
def remote_images(spark, d):
    url = F.expr("CASE page_id % 4 WHEN 0 THEN 'http://h.org/a?b=1' WHEN 1 THEN 'HTTPS://h.org' WHEN 2 THEN 'https://me@h.org/x' ELSE 'ftp://h.org/x' END")
    return table(spark, d, "pages").select("page_id", B.remote_image(url).alias("url"))


@query("SELECT event_id, event_id % 6 IN (0, 1, 4) AS inside FROM events")
def inner_paths(spark, d):
    path = F.expr("CASE event_id % 6 WHEN 0 THEN 'a/b.png' WHEN 1 THEN './a/../b.png' WHEN 2 THEN '../b.png' WHEN 3 THEN '/etc/b.png' WHEN 4 THEN 'a//b' ELSE 'a/../../b' END")
    return table(spark, d, "events").select("event_id", B.inside(path).alias("inside"))


@query(E + " SELECT doc, idx FROM b WHERE NOT (flag AND doc IN (SELECT doc FROM b GROUP BY doc HAVING sum(CASE WHEN idx % 10 = 0 THEN 1 ELSE 0 END) = 1))")
def comment_prune(spark, d):
    return B.without_comments(blocks(spark, d), "doc", F.col("idx") % 10 == 0, F.col("flag")).select("doc", "idx")


CODE = """CASE event_id % 6 WHEN 0 THEN 'def f(x):' WHEN 1 THEN 'public class A' WHEN 2 THEN 'SELECT a FROM t' WHEN 3 THEN '{"a": 1}' WHEN 4 THEN '<a>x</a>' ELSE 'nothing here' END"""


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'perl' ELSE CASE event_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'sql' WHEN 3 THEN 'json' WHEN 4 THEN 'xml' END END AS language FROM events")
def code_languages(spark, d):
    hint = F.when(F.col("event_id") % 5 == 0, " Perl ").when(F.col("event_id") % 5 == 1, "")
    return table(spark, d, "events").select("event_id", B.code_language(hint, F.expr(CODE)).alias("language"))


@query("SELECT o_orderkey, o_custkey AS ref, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT c_custkey, NULL, NULL FROM customer")
def asset_resolve(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ref")).join(c.select(F.col("c_custkey").alias("ref")), "ref", "left_semi")
    o = o.unionByName(c.select(F.col("c_custkey").alias("o_orderkey"), F.lit(None).cast("long").alias("ref")))
    text = o.withColumn("ref", F.col("ref").cast("string"))
    got = B.with_assets(text, c.select(F.col("c_custkey").cast("string").alias("ref"), F.col("c_name").alias("name")), "ref")
    return got.select("o_orderkey", F.col("ref").cast("long").alias("ref"), "name")


@query(E + " SELECT doc, type, level, count(*) AS n, count(DISTINCT page) AS pages FROM b GROUP BY doc, type, level HAVING count(*) >= 3 OR count(DISTINCT page) >= 2")
def title_prototypes(spark, d):
    return B.title_prototypes(blocks(spark, d), "doc", "page", ["type", "level"])


@query(E + """ SELECT doc, min(idx) AS first, any_value(k) AS k, list(idx ORDER BY idx) AS items FROM (SELECT *, sum(CASE WHEN flag AND k = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, level % 2 AS k, lag(level % 2) OVER (PARTITION BY doc ORDER BY idx) AS p FROM b)) GROUP BY doc, g""")
def continued_lists(spark, d):
    b = blocks(spark, d).withColumn("k", F.col("level") % 2).withColumn("items", F.array("idx")).withColumn("continues_prev", F.col("flag"))
    return B.merged_lists(b, "doc", "idx", "k")


@query(E + ", t AS (SELECT * FROM b WHERE type = 'table') SELECT a.doc, a.page, a.idx, z.idx AS prev FROM (SELECT doc, page, min(idx) AS idx FROM t GROUP BY ALL) a JOIN (SELECT doc, page, max(idx) AS idx FROM t GROUP BY ALL) z ON a.doc = z.doc AND a.page = z.page + 1")
def continued_tables(spark, d):
    return B.table_on_last_page(blocks(spark, d).where("type = 'table'"), "doc", "page", "idx").select("doc", "page", "idx", "prev")


@query(E + " SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN flag THEN NULL ELSE level END NULLS LAST, idx) AS rank FROM b")
def annotation_order(spark, d):
    b = blocks(spark, d).withColumn("at", F.when(~F.col("flag"), F.col("level")))
    return B.annotation_order(b, ["doc"], "at", "idx").select("doc", "idx", F.col("rank").cast("long").alias("rank"))


@query(E + " SELECT doc, idx, dropped FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY level DESC, idx) AS k, greatest(count(*) OVER (PARTITION BY doc) - 8, 0) AS dropped FROM b) WHERE k <= 8")
def candidate_limit(spark, d):
    return B.limited(blocks(spark, d), ["doc"], [F.desc("level"), F.asc("idx")], 8).select("doc", "idx", "dropped")


@query(E + " SELECT doc, avg(CASE WHEN level > 4 THEN 1.0 ELSE 0 END) <= 0.5 AS bullets FROM b WHERE type = 'ref_text' GROUP BY doc")
def reference_bullets(spark, d):
    return B.numbered_by_bullets(blocks(spark, d).where("type = 'ref_text'"), ["doc"], F.col("level") > 4)


@query(E + " SELECT doc, idx, page_no FROM (SELECT *, lag(page_no) OVER (PARTITION BY doc ORDER BY idx) AS p FROM (SELECT *, page + level % 3 AS page_no FROM b)) WHERE page_no <= p")
def page_map_check(spark, d):
    b = blocks(spark, d).withColumn("page_no", F.col("page") + F.col("level") % 3)
    return B.unordered(b, ["doc"], "idx", "page_no").select("doc", "idx", "page_no")


@query(E + " SELECT doc, page, count(*) AS repeated FROM (SELECT doc, page, level FROM b GROUP BY doc, page, level HAVING count(*) > 1) GROUP BY doc, page")
def page_tree_check(spark, d):
    return B.broken_trees(blocks(spark, d), ["doc", "page"], "level")


@query(E + " SELECT doc, page, CAST(sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS bodies FROM b GROUP BY doc, page HAVING sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) <> 1")
def visual_child_check(spark, d):
    return B.broken_visuals(blocks(spark, d), ["doc", "page"], F.col("type") == "table")


@query("SELECT e.event_id, 'a' || (e.event_id % 40) AS anchor, t.target FROM events e LEFT JOIN (SELECT 'a' || (event_id % 23) AS anchor, min(event_id) AS target FROM events WHERE event_type = 'view' GROUP BY 1) t ON t.anchor = 'a' || (e.event_id % 40)")
def toc_anchors(spark, d):
    e = table(spark, d, "events")
    name = lambda n: F.concat(F.lit("a"), (F.col("event_id") % n).cast("string")).alias("anchor")
    return B.toc_targets(e.select("event_id", name(40)), e.where("event_type = 'view'").select("event_id", name(23)), "anchor", "event_id")


@query("""WITH body AS (SELECT user_id, 'n' || event_id AS name, 'x#n' || (event_id + 1) AS href FROM events WHERE event_id % 3 = 0), notes AS (SELECT user_id, 'n' || event_id AS name FROM events)
 SELECT user_id, name FROM notes WHERE (user_id, name) IN (SELECT (user_id, substr(href, 3)) FROM body) AND (user_id, name) NOT IN (SELECT (user_id, name) FROM body)""")
def referenced_notes(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    body = e.where("event_id % 3 = 0").select("user_id", name.alias("name"), F.concat(F.lit("x#n"), (F.col("event_id") + 1).cast("string")).alias("href"))
    return B.referenced_notes(body, e.select("user_id", name.alias("name")), ["user_id"], "href", "name")


@query(E + """ SELECT doc, idx, (SELECT max(p.idx) FROM b p WHERE p.doc = b.doc AND p.idx < b.idx AND p.type = 'ref_text' AND NOT EXISTS (SELECT 1 FROM b q WHERE q.doc = b.doc AND q.idx > p.idx AND q.idx < b.idx AND q.type NOT IN ('header', 'ref_text'))) AS prev FROM b WHERE type = 'ref_text'""")
def previous_references(spark, d):
    return B.previous_reference(blocks(spark, d), ["doc"], "idx").where("type = 'ref_text'").select("doc", "idx", "prev")


@query(E + """, p AS (SELECT *, sum(CASE WHEN type <> 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS pl FROM b) SELECT x.doc, x.idx AS a, y.b, CAST(abs(x.pl - y.pl) AS BIGINT) AS distance
 FROM p x JOIN (SELECT doc, min(idx) AS b, min(pl) AS pl FROM p WHERE type = 'table' GROUP BY doc) y ON x.doc = y.doc WHERE x.type = 'text'""")
def effective_distance(spark, d):
    b = blocks(spark, d).withColumn("is_text", F.col("type") == "text").withColumn("is_table", F.col("type") == "table")
    return B.effective_distance(b, ["doc"], "idx", F.col("type") != "header", "is_text", "is_table")


@query("""WITH c AS (SELECT o_custkey AS t, CAST(o_orderkey % 6 AS INTEGER) AS row, CAST(1 + o_orderkey % 3 AS INTEGER) AS rowspan FROM orders), r AS (SELECT t, row, max(row + rowspan) AS e FROM c GROUP BY t, row), m AS (SELECT t, row, greatest(max(e) OVER (PARTITION BY t ORDER BY row), 1) AS reach FROM r)
 SELECT t, CAST(coalesce(min(CASE WHEN row + 1 >= 1 AND reach <= row + 1 THEN row + 1 END), (SELECT max(e) FROM r WHERE r.t = m.t)) AS INTEGER) AS n FROM m GROUP BY t""")
def header_depth(spark, d):
    c = table(spark, d, "orders").selectExpr("o_custkey AS t", "CAST(o_orderkey % 6 AS INTEGER) AS row", "CAST(1 + o_orderkey % 3 AS INTEGER) AS rowspan")
    return B.header_depth(c, ["t"], F.lit(1))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [1, 0, 1, 0] WHEN event_id % 3 = 1 THEN [0, 1, 0, 0] END AS flags, CASE event_id % 3 WHEN 0 THEN [0, 2] WHEN 1 THEN [0, 1] END AS places FROM events")
def column_projection(spark, d):
    k = F.col("event_id") % 3
    mapping = F.when(k == 0, F.array(F.lit(0), F.lit(2))).when(k == 1, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(4)))
    flags = F.when(k == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))
    narrow = F.when(k == 0, F.array(F.lit(1.0), F.lit(21.0))).when(k == 1, F.array(F.lit(0.5), F.lit(10.5))).otherwise(F.array(F.lit(20.0), F.lit(1.0)))
    wide = F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0))
    return table(spark, d, "events").select("event_id", B.projected_flags(flags, mapping, F.lit(4)).alias("flags"), B.column_mapping(narrow, wide, 2.0).alias("places"))


@query("""WITH a AS (SELECT n_regionkey AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_name AS value FROM nation), z AS (SELECT t, max(row) AS last FROM a GROUP BY t)
 SELECT t, CAST(row AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CASE WHEN row = last AND c = 0 THEN value || ' ' || lower((SELECT value FROM a f WHERE f.t = a.t AND f.row = 0)) ELSE value END AS value FROM a JOIN z USING (t), range(0, 2) r(c)
 UNION ALL SELECT t, CAST(row + last + 1 AS INTEGER), CAST(c AS INTEGER), CASE WHEN row = 0 AND c = 0 THEN '' ELSE lower(value) END FROM a JOIN z USING (t), range(0, 2) r(c)""")
def cell_merge(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("t"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("row"), F.col("n_name").alias("value"))
    n = n.withColumn("col", F.explode(F.array(F.lit(0), F.lit(1))))
    flags = n.select("t", F.lit(0).alias("col")).distinct()
    return B.extended_cells(n, n.withColumn("value", F.lower("value")), ["t"], flags)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN '<table><tr><th>Name</th><th>&lt;k&gt;</th></tr><tr><td>' || n_name || '</td><td>' || n_nationkey || '</td></tr></table>' END AS html FROM nation")
def pipe_tables(spark, d):
    dash = F.when(F.col("n_nationkey") % 3 == 0, "|---|:-:|").when(F.col("n_nationkey") % 3 == 1, "--- | ---").otherwise("|---|")
    text = F.concat(F.lit("| Name | <k> |\n"), dash, F.lit("\n| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    return table(spark, d, "nation").select("n_nationkey", B.pipe_table(text).alias("html"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' END AS mime, CASE event_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 END AS bytes FROM events")
def data_uris(spark, d):
    uri = F.expr("CASE event_id % 4 WHEN 0 THEN 'data:image/png;base64,iVBORw0KGgo=' WHEN 1 THEN 'data:image/gif;base64,R0lGODlh' WHEN 2 THEN 'data:image/png;base64,R0lGODlh' ELSE 'data:text/plain,x' END")
    got = B.data_uri(uri)
    return table(spark, d, "events").select("event_id", got["mime"].alias("mime"), F.length(got["payload"]).alias("bytes"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['page'] ELSE ['page', 'ref'] END AS names FROM events")
def public_names(spark, d):
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("page"), F.lit(1), F.lit("_x"), F.lit(2))).otherwise(F.create_map(F.lit("page"), F.lit(1), F.lit("ref"), F.lit(2)))
    return table(spark, d, "events").select("event_id", F.array_sort(F.map_keys(B.public_fields(m))).alias("names"))


@query("""SELECT o_orderkey, CASE WHEN k < 4 THEN list_sort(list_distinct(list_concat(range(a, a + 3), [a + 1, a + 9]))) END AS pages, CASE WHEN k < 4 THEN a || '-' || (a + 2) || ',' || (a + 9) END AS text, CASE WHEN k = 0 THEN 9 ELSE least(k, 9) END AS last FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 1 + o_custkey % 9 AS a FROM orders)""")
def page_sets(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 5 AS k", "1 + o_custkey % 9 AS a")
    s = lambda c: c.cast("string")
    raw = F.concat(s(F.col("a") + 9), F.lit(", "), s(F.col("a")), F.lit("-"), s(F.col("a") + 2), F.lit(","), s(F.col("a") + 1))
    pages = B.page_set(F.when(F.col("k") < 4, raw).otherwise("4-x"))
    end = F.when(F.col("k") == 0, -1).otherwise(F.col("k"))
    d_ = o.withColumn("p", pages)
    return d_.select("o_orderkey", F.transform("p", lambda x: x.cast("long")).alias("pages"), F.when(F.col("p").isNotNull(), B.page_ranges(F.col("p"))).alias("text"), B.last_page(end, F.lit(10)).cast("long").alias("last"))
