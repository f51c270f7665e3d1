"""Rules on document blocks and on tables as a whole: promotion, filters, merging of what pages break, checks, links to assets and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.relational import bins, first_by, last_behind_barrier

# Block types by the way that their text is put together, and signatures of picture formats.
TEXTUAL = ("text", "ref_text", "list", "index")
SIGNATURES = {"image/png": "89504E47", "image/jpeg": "FFD8FF", "image/gif": "47494638", "image/bmp": "424D"}


def raw_blocks(blocks: DataFrame, page: list[str], order: str) -> DataFrame:
    """Blocks as an analyser hands them over: title types by name, section levels 2 to 6, ``index`` by position on the page."""
    kind = F.when(F.col("type") == "title", "paragraph_title").otherwise(F.col("type"))
    level = F.when(kind == "paragraph_title", F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce("level", F.lit(2))))).when(kind == "doc_title", F.lit(1))
    position = F.row_number().over(Window.partitionBy(*page).orderBy(order)) - 1
    return blocks.withColumn("type", kind).withColumn("level", level).withColumn("index", position)


def by_role(blocks: DataFrame) -> DataFrame:
    """Adds ``role``: the textual type of a block, or 'other'."""
    return blocks.withColumn("role", F.when(F.col("type").isin(*TEXTUAL), F.col("type")).otherwise("other"))


def index_lines(blocks: DataFrame) -> DataFrame:
    """A table of contents' block as one row for each line that isn't blank, with ``child`` numbers from 0."""
    parts = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return blocks.select(*[c for c in blocks.columns if c != "text"], F.posexplode(parts).alias("child", "text"))


def layout_regions(blocks: DataFrame, keys: list[str], children: str) -> DataFrame:
    """(keys, path, type, x0, y0, x1, y1): blocks and their children (an array of structs) as rows; a path is places from the top, by dots."""
    own = blocks.select(*keys, F.col("idx").cast("string").alias("path"), "type", "x0", "y0", "x1", "y1")
    inner = blocks.select(*keys, "idx", F.posexplode(children).alias("k", "c"))
    return own.unionByName(inner.select(*keys, F.concat_ws(".", "idx", "k").alias("path"), "c.type", "c.x0", "c.y0", "c.x1", "c.y1"))


def not_painted_over(texts: DataFrame, paint: DataFrame, keys: list[str], width: float = 100.0) -> DataFrame:
    """Texts (idx, z) that no later painted box (px0, py0, px1, py1, pz) covers wholly; both meet by bins of ``width`` points."""
    t = texts.withColumn("__bin", F.floor(F.col("x0") / width).cast("long"))
    p = paint.withColumn("__bin", F.explode(bins(F.col("px0"), F.col("px1"), width)))
    over = (F.col("pz") > F.col("z")) & (F.col("px0") <= F.col("x0")) & (F.col("py0") <= F.col("y0")) & (F.col("px1") >= F.col("x1")) & (F.col("py1") >= F.col("y1"))
    gone = t.join(p, [*keys, "__bin"]).where(over).select(*keys, "idx").distinct()
    return texts.join(gone, [*keys, "idx"], "left_anti")


def upright(runs: DataFrame, angle: str, tolerance: float = 5.0) -> DataFrame:
    """Runs whose writing angle is within ``tolerance`` degrees of a quarter turn."""
    off = F.pmod(F.col(angle), F.lit(90.0))
    return runs.where((off <= tolerance) | (off >= 90 - tolerance))


def remote_image(url: Column) -> Column:
    """The URL of a picture elsewhere: http or https, with a host and without a user's name; else null."""
    return F.when(url.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]\S*)?$"), url)


def inside(path: Column) -> Column:
    """Whether a relative path stays below the folder it starts from."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    depth = F.transform(parts, lambda x: F.when(x == "..", -1).otherwise(1))
    least = F.aggregate(depth, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, d: F.struct((a["at"] + d).alias("at"), F.least(a["low"], a["at"] + d).alias("low")))["low"]
    return (F.size(parts) > 0) & (least >= 0) & ~path.rlike(r"^([/\\]|[A-Za-z]:)")


def without_comments(blocks: DataFrame, doc: str, article: Column, comment: Column) -> DataFrame:
    """Blocks without those of comments, in documents that have exactly one article; others stay as they are."""
    one = F.sum(article.cast("int")).over(Window.partitionBy(doc)) == 1
    return blocks.withColumn("__one", one).where(~(F.col("__one") & comment)).drop("__one")


def code_language(hint: Column, code: Column) -> Column:
    """The hinted language, or the first whose mark the code bears; null if none does."""
    marks = (
        ("python", r"(?m)^\s*(def \w+\(|import \w+|from \w+ import )"), ("java", r"\bpublic (class|static)\b"), ("cpp", r"(?m)^\s*#include\b"), ("sql", r"(?is)^\s*(select|insert|update|create)\b.*\b(from|into|set|table)\b"),
        ("xml", r"(?s)^\s*<[?\w]"), ("json", r"(?s)^\s*[\[{]\s*[\"\]}\[{]"), ("shell", r"(?m)^(#!.*sh|\$ )"), ("javascript", r"\b(function \w*\(|const \w+ =|=> \{)"),
    )
    guess = F.lit(None).cast("string")
    for name, mark in reversed(marks):
        guess = F.when(code.rlike(mark), name).otherwise(guess)
    return F.coalesce(F.lower(F.nullif(F.trim(hint), F.lit(""))), guess)


def with_assets(blocks: DataFrame, assets: DataFrame, ref: str) -> DataFrame:
    """Blocks with their assets' columns by reference; a reference without an asset raises, a block without a reference has nulls."""
    one = assets.dropDuplicates([ref])
    d = blocks.join(one.withColumn("__found", F.lit(True)), ref, "left")
    missing = F.col(ref).isNotNull() & F.col("__found").isNull()
    return d.withColumn(ref, F.when(missing, F.raise_error(F.concat(F.lit("no asset "), F.col(ref)))).otherwise(F.col(ref))).drop("__found")


def title_prototypes(seeds: DataFrame, doc: str, page: str, style: list[str], least: int = 3, pages: int = 2) -> DataFrame:
    """(doc, style, n, pages): styles that at least ``least`` title seeds share, or seeds on at least ``pages`` pages."""
    g = seeds.groupBy(doc, *style).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(page).alias("pages"))
    return g.where((F.col("n") >= least) | (F.col("pages") >= pages))


def merged_lists(blocks: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """(doc, first, kind, items): lists that go on from the list block before them, of the same kind, as one."""
    w = Window.partitionBy(doc).orderBy(order)
    same = F.col("continues_prev") & (F.lag(kind).over(w) == F.col(kind))
    d = blocks.withColumn("__g", F.sum(F.when(same, 0).otherwise(1)).over(w))
    items = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "items"))), lambda x: x["items"]))
    return d.groupBy(doc, "__g").agg(F.min(order).alias("first"), F.first(kind).alias(kind), items.alias("items")).drop("__g")


def table_on_last_page(tables: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """(doc, page, order, prev): each page's first table with the last table of the page before."""
    first = tables.groupBy(doc, page).agg(F.min(order).alias(order))
    last = tables.groupBy(doc, (F.col(page) + 1).alias(page)).agg(F.max(order).alias("prev"))
    return first.join(last, [doc, page])


def annotation_order(items: DataFrame, keys: list[str], index: str, position: str) -> DataFrame:
    """Adds ``rank``: by index, those without one last, then by position."""
    w = Window.partitionBy(*keys).orderBy(F.col(index).asc_nulls_last(), position)
    return items.withColumn("rank", F.row_number().over(w))


def limited(candidates: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` candidates of each key, with ``dropped``: how many more there were."""
    w = Window.partitionBy(*keys)
    d = candidates.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("dropped", F.greatest(F.count(F.lit(1)).over(w) - most, F.lit(0)))
    return d.where(F.col("__k") <= most).drop("__k")


def numbered_by_bullets(lists: DataFrame, keys: list[str], numbered: Column) -> DataFrame:
    """(keys, bullets): whether at most half of a reference list's entries bear their own numbers."""
    return lists.groupBy(*keys).agg((F.avg(numbered.cast("double")) <= 0.5).alias("bullets"))


def unordered(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't more than the one's before: a map of page numbers must have none."""
    return rows.withColumn("__p", F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).where(F.col(value) <= F.col("__p")).drop("__p")


def broken_trees(blocks: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, repeated): pages whose blocks' indices repeat, and how many indices do."""
    g = blocks.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return g.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeated"))


def broken_visuals(children: DataFrame, keys: list[str], body: Column) -> DataFrame:
    """(keys, bodies): picture, table and chart groups that don't have exactly one body."""
    return children.groupBy(*keys).agg(F.count_if(body).alias("bodies")).where("bodies <> 1")


def toc_targets(leaves: DataFrame, targets: DataFrame, anchor: str, order: str) -> DataFrame:
    """Leaves of a table of contents with ``target``, the first block that bears their anchor; null where none does."""
    first = first_by(targets, [anchor], F.col(order), [order]).withColumnRenamed(order, "target")
    return leaves.join(first, anchor, "left")


def referenced_notes(body: DataFrame, notes: DataFrame, keys: list[str], href: str, name: str) -> DataFrame:
    """Notes that a link in the body names by its fragment and that the body doesn't hold itself."""
    named = body.select(*keys, F.regexp_extract(href, "#(.+)$", 1).alias(name)).where(F.col(name) != "").distinct()
    return notes.join(named, [*keys, name], "left_semi").join(body.select(*keys, name).distinct(), [*keys, name], "left_anti")


def previous_reference(blocks: DataFrame, keys: list[str], order: str, out: str = "prev") -> DataFrame:
    """Adds ``out``: the reference block before, if only page furniture stands between."""
    kind = F.col("type")
    furniture = kind.isin("header", "footer", "page_number", "page_footnote", "aside_text")
    return last_behind_barrier(blocks, keys, order, kind == "ref_text", ~furniture & (kind != "ref_text"), F.col(order), out)


def effective_distance(blocks: DataFrame, keys: list[str], order: str, counted: Column, a: str, b: str) -> DataFrame:
    """(keys, a, b, distance): how many counted blocks further one of two named blocks stands than the other."""
    place = F.sum(counted.cast("int")).over(Window.partitionBy(*keys).orderBy(order))
    d = blocks.withColumn("__p", place)
    x = d.where(F.col(a)).select(*keys, F.col(order).alias("a"), F.col("__p").alias("__a"))
    y = d.where(F.col(b)).groupBy(*keys).agg(F.min(order).alias("b"), F.min("__p").alias("__b"))
    return x.join(y, keys).select(*keys, "a", "b", F.abs(F.col("__a") - F.col("__b")).alias("distance"))


def header_depth(cells: DataFrame, keys: list[str], header: Column) -> DataFrame:
    """(keys, n): a table's header rows (row < ``header``), and those below that their cells span into."""
    rows = cells.groupBy(*keys, "row").agg(F.max(F.col("row") + F.col("rowspan")).alias("__end"), F.max(header).alias("__h"))
    reach = F.max("__end").over(Window.partitionBy(*keys).orderBy("row"))
    d = rows.withColumn("__reach", F.greatest(reach, "__h")).withColumn("__closed", (F.col("row") + 1 >= F.col("__h")) & (F.col("__reach") <= F.col("row") + 1))
    got = d.groupBy(*keys).agg(F.min(F.when(F.col("__closed"), F.col("row") + 1)).alias("n"), F.max("__end").alias("__all"))
    return got.select(*keys, F.coalesce("n", "__all").alias("n"))


def same_columns(a: Column, b: Column) -> Column:
    """Whether two rows (arrays of cells with colspan) have as many cells, of the same spans."""
    spans = lambda r: F.transform(r, lambda c: c["colspan"])
    return (F.size(a) == F.size(b)) & (spans(a) == spans(b))


def projected_flags(flags: Column, mapping: Column, width: Column) -> Column:
    """0/1 flags of a narrow table's columns at their places in a wide one; null if a place is outside."""
    hit = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.when(F.exists(F.zip_with(flags, mapping, lambda f, m: (f == 1) & (m == k)), lambda x: x), 1).otherwise(0))
    return F.when(~F.exists(mapping, lambda m: (m < 0) | (m >= width)), hit)


def column_mapping(narrow: Column, wide: Column, tolerance: float) -> Column:
    """The place of each of ``narrow``'s edges among ``wide``'s: the nearest within ``tolerance``; null unless all have one and they ascend."""
    nearest = F.transform(narrow, lambda x: F.array_min(F.transform(wide, lambda y, k: F.struct(F.abs(x - y).alias("d"), k.alias("k")))))
    places = F.transform(nearest, lambda n: n["k"])
    ok = ~F.exists(nearest, lambda n: n["d"] > tolerance) & (F.size(F.array_distinct(places)) == F.size(places)) & (F.array_sort(places) == places)
    return F.when(ok, places)


def extended_cells(first: DataFrame, second: DataFrame, keys: list[str], flags: DataFrame) -> DataFrame:
    """(keys, row, col, value): the second table's rows under the first's; in flagged columns (keys, col) its first row's text is put behind the first table's last cell."""
    last = first.groupBy(*keys).agg(F.max("row").alias("__last"))
    lead = second.where("row = 0").join(flags, [*keys, "col"], "left_semi").select(*keys, "col", F.col("value").alias("__more"))
    a = first.join(last, keys).join(lead, [*keys, "col"], "left")
    a = a.select(*keys, "row", "col", F.when((F.col("row") == F.col("__last")) & F.col("__more").isNotNull(), F.concat("value", F.lit(" "), "__more")).otherwise(F.col("value")).alias("value"))
    b = second.join(last, keys).join(flags.withColumn("__f", F.lit(1)), [*keys, "col"], "left")
    b = b.select(*keys, (F.col("row") + F.col("__last") + 1).alias("row"), "col", F.when((F.col("row") == 0) & F.col("__f").isNotNull(), "").otherwise(F.col("value")).alias("value"))
    return a.unionByName(b)


def pipe_table(text: Column) -> Column:
    """The HTML of a pipe table: a header line, a line of dashes and rows of as many cells; null for any other text."""
    rows = F.transform(F.split(F.trim(text), "\n"), lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    n = F.size(F.element_at(rows, 1))
    fine = (F.size(rows) >= 2) & ~F.exists(rows, lambda r: F.size(r) != n) & ~F.exists(F.get(rows, F.lit(1)), lambda c: ~c.rlike("^:?-+:?$"))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), lambda r: line(r, "td")), "")
    return F.when(fine, F.concat(F.lit("<table>"), line(F.element_at(rows, 1), "th"), body, F.lit("</table>")))


def data_uri(uri: Column) -> Column:
    """struct(mime, payload) of a picture's data URI whose bytes bear its format's signature; null for any other."""
    mime = F.lower(F.regexp_extract(uri, r"^data:([a-zA-Z]+/[a-zA-Z0-9.+-]+);base64,", 1))
    body = F.regexp_extract(uri, r"^data:[^,]*;base64,([A-Za-z0-9+/]+={0,2})$", 1)
    payload = F.try_to_binary(body, F.lit("base64"))
    start = F.hex(F.substring(payload, 1, 4))
    fine = F.lit(False)
    for name, mark in SIGNATURES.items():
        fine = fine | ((mime == name) & start.startswith(mark))
    return F.when(F.coalesce(fine, F.lit(False)) & (body != ""), F.struct(mime.alias("mime"), payload.alias("payload")))


def public_fields(fields: Column) -> Column:
    """A map without the entries whose names begin with an underscore."""
    return F.map_filter(fields, lambda k, v: ~k.startswith("_"))


def page_set(raw: Column) -> Column:
    """The ascending page numbers of a text such as 1-3,5: ranges may overlap and stand in any order; null if a part is no range."""
    parts = F.split(F.regexp_replace(raw, r"\s+", ""), ",")
    fine = ~F.exists(parts, lambda p: ~p.rlike(r"^[1-9]\d{0,5}(-[1-9]\d{0,5})?$"))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: x.try_cast("int")))
    pages = F.transform(ends, lambda e: F.when(F.element_at(e, 1) <= F.element_at(e, -1), F.sequence(F.element_at(e, 1), F.element_at(e, -1))))
    return F.when(fine & ~F.exists(pages, lambda p: p.isNull()), F.array_sort(F.array_distinct(F.flatten(pages))))


def page_ranges(pages: Column) -> Column:
    """The shortest text of ascending page numbers: neighbours as a range."""
    runs = F.aggregate(
        pages, F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == p - 1),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), p.alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.alias("a"), p.alias("b"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))), ",")


def last_page(end: Column, count: Column) -> Column:
    """The last page to read, from 0: the wanted one, or the document's last if it is negative, missing or beyond."""
    return F.when(end.isNull() | (end < 0) | (end >= count), count - 1).otherwise(end)
