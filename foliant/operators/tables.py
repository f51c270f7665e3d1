"""Table algebra: grids, spans, header votes, regions and the forms they are written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import escape_html, strip
from foliant.operators.components import connected_components


def value_kind(value: Column) -> Column:
    """number, boolean, date or text; null for a blank value."""
    v = strip(value)
    digits = F.regexp_replace(F.regexp_replace(v, "%$", ""), "[, _ ]", "")
    number = digits.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    date = v.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?)?$") | v.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?$")
    return F.when((v == "") | v.isNull(), None).when(number, "number").when(F.lower(v).isin("true", "false", "yes", "no"), "boolean").when(date, "date").otherwise("text")


def dominant_kinds(cells: DataFrame, keys: list[str], value: str, least: float = 0.9) -> DataFrame:
    """(keys, n, kind): the kind that at least ``least`` of a column's values have; null if none has."""
    k = cells.withColumn("__k", value_kind(F.col(value))).where("__k is not null")
    n = lambda kind: F.count_if(F.col("__k") == kind)
    agg = k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[n(x).alias(f"__{x}") for x in ("number", "boolean", "date", "text")])
    kind = F.coalesce(*[F.when(F.col(f"__{x}") >= least * F.col("n"), x) for x in ("number", "boolean", "date", "text")])
    return agg.select(*keys, "n", kind.alias("kind"))


def header_votes(cells: DataFrame, keys: list[str], sample: int = 50) -> DataFrame:
    """(keys, header_votes, data_votes, has_header) from cells (row, col, value): does row 0 name the columns?

    A column whose body is of one kind other than text votes for a header if
    its label is text, else against; a label that its own column repeats
    votes against. The first ``sample`` body rows are looked at.
    """
    head = cells.where("row = 0").select(*keys, "col", F.col("value").alias("label"))
    body = cells.where((F.col("row") > 0) & (F.col("row") <= sample))
    kinds = dominant_kinds(body, [*keys, "col"], "value")
    again = body.join(head, [*keys, "col"]).where(F.lower(strip(F.col("value"))) == F.lower(strip(F.col("label")))).select(*keys, "col", F.lit(1).alias("again")).distinct()
    j = head.join(kinds, [*keys, "col"]).join(again, [*keys, "col"], "left")
    typed = F.col("kind").isNotNull() & (F.col("kind") != "text")
    label = value_kind(F.col("label"))
    yes = typed & (F.coalesce(label == "text", F.lit(False)) | ((F.col("col") == 0) & label.isNull()))
    no = (typed & ~yes) | (~typed & F.col("again").isNotNull() & label.isNotNull())
    votes = j.groupBy(*keys).agg(F.count_if(yes).alias("header_votes"), F.count_if(no).alias("data_votes"))
    has = F.when((F.col("header_votes") > 0) | (F.col("data_votes") > 0), F.col("header_votes") > F.col("data_votes")).otherwise(True)
    return votes.withColumn("has_header", has)


def padded(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every (row, col) slot of each grid's bounds, blanks where no cell was."""
    size = cells.groupBy(*keys).agg(F.max("row").alias("__r"), F.max("col").alias("__c"))
    slots = size.select(*keys, F.explode(F.sequence(F.lit(0), F.col("__r"))).alias("row"), "__c").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("__c"))).alias("col"))
    return slots.join(cells, [*keys, "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def trimmed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Without the trailing rows and columns that hold nothing."""
    full = F.when(F.coalesce(strip(F.col("value")), F.lit("")) != "", 1)
    last = cells.groupBy(*keys).agg(F.max(full * F.col("row")).alias("__r"), F.max(full * F.col("col")).alias("__c"))
    return cells.join(last, keys).where("row <= __r and col <= __c").drop("__r", "__c")


def to_html(cells: DataFrame, keys: list[str], header: Column | None = None) -> DataFrame:
    """(keys, html): a table element; row 0 has th cells where ``header`` holds. Cells are (row, col, value)."""
    top = (F.col("row") == 0) & (F.lit(False) if header is None else header)
    tag = F.when(top, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.coalesce("value", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = cells.select(*keys, "row", "col", cell.alias("__h")).groupBy(*keys, "row").agg(_in_order("col", "__h", "").alias("__h"))
    rows = rows.withColumn("__h", F.concat(F.lit("<tr>"), "__h", F.lit("</tr>")))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), _in_order("row", "__h", ""), F.lit("</table>")).alias("html"))


def to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): a pipe table, its first row the header."""
    text = F.replace(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s*\n\s*", "<br>"), F.lit("|"), F.lit("\\|"))
    rows = cells.select(*keys, "row", "col", text.alias("__t")).groupBy(*keys, "row").agg(_in_order("col", "__t", " | ").alias("__t"), F.count(F.lit(1)).cast("int").alias("__n"))
    line = F.concat(F.lit("| "), "__t", F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("__n")))
    rows = rows.withColumn("__t", F.when(F.col("row") == 0, F.concat(line, rule)).otherwise(line))
    return rows.groupBy(*keys).agg(_in_order("row", "__t", "\n").alias("markdown"))


def _in_order(order: str, value: str, sep: str) -> Column:
    """Aggregate: values joined in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep)


def occupied(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, owner): every slot that cells (row, col, rowspan, colspan, cell) cover."""
    d = cells.withColumn("__r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)))
    d = d.withColumn("__c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    return d.groupBy(*keys, F.col("__r").alias("row"), F.col("__c").alias("col")).agg(F.min("cell").alias("owner"))


def segments(slots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, owner, lo, hi): runs of neighbouring columns of one owner."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    new = F.coalesce((F.lag("owner").over(w) != F.col("owner")) | (F.lag("col").over(w) != F.col("col") - 1), F.lit(True))
    d = slots.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(w))
    return d.groupBy(*keys, "row", "__g").agg(F.min("owner").alias("owner"), F.min("col").alias("lo"), F.max("col").alias("hi")).drop("__g")


def regions(cells: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """(keys, region, top, left, bottom, right, n): cells (row, col) that bridges of at most ``gap`` blanks connect.

    A cell is linked to the next one in its row and in its column if that is
    at most gap + 1 away; regions are the connected components.
    """
    named = cells.select(*keys, "row", "col").distinct().withColumn("cell", F.xxhash64(*keys, "row", "col"))
    edges = []
    for along, across in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(*keys, along).orderBy(across)
        d = named.select(F.col("cell").alias("src"), F.lead("cell").over(w).alias("dst"), (F.lead(across).over(w) - F.col(across)).alias("d"))
        edges.append(d.where(F.col("d") <= gap + 1).select("src", "dst"))
    comp = connected_components(edges[0].union(edges[1]))
    d = named.join(comp, named.cell == comp.node, "left").withColumn("__c", F.coalesce("component", "cell"))
    out = d.groupBy(*keys, "__c").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("region", F.row_number().over(Window.partitionBy(*keys).orderBy("top", "left", "bottom", "right"))).drop("__c")


def boundary_tables(blocks: DataFrame, doc: str = "doc_id", page: str = "page_idx", order: str = "idx") -> DataFrame:
    """Pairs (doc, prev_page, prev_idx, idx): the last table of a page and the first of the next, with only page furniture outside them."""
    body = blocks.where(~F.col("type").isin("header", "footer", "page_number", "page_footnote"))
    ends = body.groupBy(doc, page).agg(F.min(F.struct(order, "type")).alias("a"), F.max(F.struct(order, "type")).alias("z"))
    last = ends.where(F.col("z.type") == "table").select(doc, (F.col(page) + 1).alias(page), F.col(f"z.{order}").alias("prev_idx"))
    first = ends.where(F.col("a.type") == "table").select(doc, page, F.col(f"a.{order}").alias("idx"))
    return last.join(first, [doc, page]).select(doc, (F.col(page) - 1).alias("prev_page"), "prev_idx", "idx")


def gap_penalty(s: Column) -> Column:
    """How badly a split of a sheet into regions fits its shape ratios."""
    return 6 * s["severe"] + 2.5 * s["blank_line"] + 1.5 * s["sparse"] + s["single"] + 0.5 * s["blank"] + s["overlap"]


def best_gap(candidates: DataFrame, keys: list[str], margin: float = 0.15) -> DataFrame:
    """(keys, gap): of the gaps within ``margin`` of the least penalty: least severe, then 1 before 0 before 2, then fewest blank lines."""
    d = candidates.withColumn("__p", gap_penalty(F.col("summary")))
    d = d.withColumn("__best", F.min("__p").over(Window.partitionBy(*keys))).where(F.col("__p") <= F.col("__best") + margin)
    taste = F.when(F.col("gap") == 1, 0).when(F.col("gap") == 0, 1).otherwise(2)
    return d.groupBy(*keys).agg(F.min_by("gap", F.struct(F.col("summary.severe"), taste, F.col("summary.blank_line"), F.col("__p"))).alias("gap"))


def header_rows(pairs: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, n): how many leading rows two tables share, from rows (side 0 or 1, row, cells)."""
    a = pairs.where(f"side = 0 and row < {most}").select(*keys, "row", F.col("cells").alias("p"))
    b = pairs.where(f"side = 1 and row < {most}").select(*keys, "row", F.col("cells").alias("q"))
    j = a.join(b, [*keys, "row"]).withColumn("__off", (F.col("p") != F.col("q")).cast("int"))
    w = Window.partitionBy(*keys).orderBy("row")
    j = j.withColumn("__bad", F.sum("__off").over(w))
    return j.groupBy(*keys).agg(F.count_if(F.col("__bad") == 0).alias("n"))


def mergeable(p, c, width_tolerance: float = 0.1) -> Column:
    """Whether a table (n_cols, width, last_cols, footnotes, caption) goes on in the next page's (n_cols, width, first_cols, caption)."""
    from foliant.functions.text import is_continued_caption

    goes_on = F.coalesce(is_continued_caption(c["caption"]), F.lit(False))
    named = F.coalesce(F.trim(c["caption"]), F.lit("")) != ""
    notes = F.coalesce(p["footnotes"], F.lit(0))
    widths = F.abs(p["width"] - c["width"]) / F.least(p["width"], c["width"]) < width_tolerance
    return (~named | goes_on) & (notes <= F.when(goes_on, 1).otherwise(0)) & widths & ((p["n_cols"] == c["n_cols"]) | (p["last_cols"] == c["first_cols"]))


def merged(first: DataFrame, second: DataFrame, keys: list[str], headers: DataFrame) -> DataFrame:
    """(keys, row, col, value): the first table's cells and then the second's, without the header rows that they share (keys, n)."""
    rows = first.groupBy(*keys).agg((F.max("row") + 1).alias("__rows"))
    tail = second.join(headers, keys, "left").join(rows, keys).withColumn("n", F.coalesce("n", F.lit(0))).where("row >= n")
    tail = tail.select(*keys, (F.col("row") - F.col("n") + F.col("__rows")).cast("int").alias("row"), "col", "value")
    return first.select(*keys, F.col("row").cast("int").alias("row"), "col", "value").unionByName(tail)
