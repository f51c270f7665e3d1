"""Tables, drawings and marks on pages: rules and rectangles as evidence, text assigned to cells, regions and styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.components import connected_components
from foliant.operators.layout import per_group
from foliant.operators.relational import bins, merged_intervals

NUMERIC = r"^[-+(]?[$€£]?\d[\d,. ]*\)?%?$"
YEAR = r"^(19|20)\d\d$"


def _tall() -> Column:
    return F.col("y1") - F.col("y0")


def _wide() -> Column:
    return F.col("x1") - F.col("x0")


def ruled_tables(rules: DataFrame, keys: list[str], widest: float, least: int = 3, snap: float = 2.0) -> DataFrame:
    """(keys, left, right, x0, x1, top, bottom, n): at least ``least`` horizontal rules of one span, none over ``widest`` below the last."""
    d = rules.withColumn("left", F.round(F.col("x0") / snap)).withColumn("right", F.round(F.col("x1") / snap))
    w = Window.partitionBy(*keys, "left", "right").orderBy("y")
    d = d.withColumn("__t", F.sum(F.when(F.col("y") - F.lag("y").over(w) <= widest, 0).otherwise(1)).over(w))
    g = d.groupBy(*keys, "left", "right", "__t").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).drop("__t")


def rule_bands(rules: DataFrame, lines: DataFrame, keys: list[str], width: float = 50.0) -> DataFrame:
    """(keys, top, bottom, n): bands between neighbouring rules of a page that hold lines, by the lines' centres; lines meet bands by bins."""
    w = Window.partitionBy(*keys).orderBy("y")
    bands = rules.select(*keys, "y").distinct().withColumn("bottom", F.lead("y").over(w)).where("bottom is not null").withColumnRenamed("y", "top")
    bands = bands.withColumn("__bin", F.explode(bins(F.col("top"), F.col("bottom"), width)))
    centre = (F.col("y0") + F.col("y1")) / 2
    p = lines.select(*keys, centre.alias("__c")).withColumn("__bin", F.floor(F.col("__c") / width).cast("long"))
    hit = p.join(bands, [*keys, "__bin"]).where((F.col("__c") >= F.col("top")) & (F.col("__c") < F.col("bottom")))
    return hit.groupBy(*keys, "top", "bottom").agg(F.count(F.lit(1)).alias("n"))


def stable_columns(lines: DataFrame, keys: list[str], snap: float, share: float) -> DataFrame:
    """(keys, rows, columns): left edges (rounded to ``snap``) that at least ``share`` of the page's rows have."""
    d = lines.select(*keys, F.round(F.col("x0") / snap).alias("__x"), F.round(F.col("y0") / snap).alias("__y")).distinct()
    rows = d.select(*keys, "__y").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    edges = d.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n")).join(rows, keys)
    return edges.groupBy(*keys, "rows").agg(F.count_if(F.col("__n") >= share * F.col("rows")).alias("columns"))


def filled_grids(rects: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, rows, columns, x0, y0, x1, y1): pages whose filled rectangles are a whole lattice of at least ``least`` rows and columns."""
    d = rects.withColumn("__x", F.round("x0")).withColumn("__y", F.round("y0"))
    g = d.groupBy(*keys).agg(
        F.count_distinct("__y").alias("rows"), F.count_distinct("__x").alias("columns"), F.count_distinct("__x", "__y").alias("__n"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return g.where((F.col("rows") >= least) & (F.col("columns") >= least) & (F.col("__n") == F.col("rows") * F.col("columns"))).drop("__n")


def numeric_columns(cells: DataFrame, keys: list[str], least: int = 3, share: float = 0.8) -> DataFrame:
    """(keys, right, n, share): right edges at which at least ``least`` texts end, ``share`` of them numbers."""
    g = cells.groupBy(*keys, F.round("x1").alias("right")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("text").rlike(NUMERIC).cast("double")).alias("share"))
    return g.where((F.col("n") >= least) & (F.col("share") >= share))


def year_headers(cells: DataFrame, keys: list[str], row: str, least: int = 2) -> DataFrame:
    """(keys, row, years, numbers): rows with at least ``least`` years, and how many number cells stand below such a row."""
    rows = cells.groupBy(*keys, row).agg(F.count_if(F.col("text").rlike(YEAR)).alias("years"), F.count_if(F.col("text").rlike(NUMERIC) & ~F.col("text").rlike(YEAR)).alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*keys).orderBy(row).rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("numbers", F.coalesce(below, F.lit(0))).where(F.col("years") >= least).drop("__n")


def without_prose_tail(rows: DataFrame, keys: list[str], row: str, data: Column) -> DataFrame:
    """The rows up to the last one that holds data; keys without any keep all."""
    last = F.max(F.when(data, F.col(row))).over(Window.partitionBy(*keys))
    return rows.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(row) <= F.col("__last"))).drop("__last")


def note_rows(rows: DataFrame, cells: DataFrame, keys: list[str], pattern: str = r"^([*†‡§a-d]|\(\d\))\s") -> DataFrame:
    """Rows (keys, text) under a table whose mark stands at the end of one of the table's cells."""
    mark = F.regexp_extract("text", pattern, 1)
    marks = cells.select(*keys, F.regexp_extract("text", r"([*†‡§a-d]|\(\d\))$", 1).alias("__m")).where("__m <> ''").distinct()
    return rows.withColumn("__m", mark).join(marks, [*keys, "__m"], "left_semi").drop("__m")


def caption_groups(tables: DataFrame, captions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, caption, left, right, n, top, bottom): tables of one span under one caption - the last above each - as one.

    Captions and tables are one stream from the top, along which the last caption is carried.
    """
    t = tables.select(*keys, "left", "right", "top", "bottom", F.col("top").alias("__y"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("caption"))
    c = captions.select(*keys, F.col("y1").alias("__y"), F.lit(0).alias("__side"), F.col("idx").cast("long").alias("caption"))
    w = Window.partitionBy(*keys).orderBy("__y", "__side", F.col("caption").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = t.unionByName(c, allowMissingColumns=True).withColumn("caption", F.last("caption", ignorenulls=True).over(w))
    g = both.where("__side = 1 and caption is not null").groupBy(*keys, "caption", "left", "right")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def _overlap() -> Column:
    wide = F.greatest(F.lit(0.0), F.least("x1", "cx1") - F.greatest("x0", "cx0"))
    return wide * F.greatest(F.lit(0.0), F.least("y1", "cy1") - F.greatest("y0", "cy0"))


def assigned_cells(glyphs: DataFrame, cells: DataFrame, keys: list[str], glyph: str = "idx", cell: str = "cell", width: float = 100.0) -> DataFrame:
    """(keys, idx, cell, ambiguous): the cell (cx0, cy0, cx1, cy1) that covers most of a glyph; the larger index wins a tie.

    A glyph that no cell covers goes to the one cell that holds its centre,
    or to none. It is ambiguous if a second cell covers 0.45 of it and comes
    within 0.02 of the first. Glyphs meet cells by bins of ``width`` points.
    """
    g = glyphs.withColumn("__bin", F.explode(bins(F.col("x0"), F.col("x1"), width)))
    c = cells.withColumn("__bin", F.explode(bins(F.col("cx0"), F.col("cx1"), width)))
    centre = ((F.col("x0") + F.col("x1")) / 2).between(F.col("cx0"), F.col("cx1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("cy0"), F.col("cy1"))
    pair = g.join(c, [*keys, "__bin"]).withColumn("__r", _overlap() / (_wide() * _tall())).withColumn("__in", centre)
    pair = pair.where("__r > 0 or __in").select(*keys, glyph, cell, "__r", "__in").distinct()
    best = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("__r").alias("r"), F.col(cell).alias("c")))))
    got = pair.groupBy(*keys, glyph).agg(best.alias("b"), F.count_if(F.col("__in")).alias("__n"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))["r"]
    chosen = F.when(first["r"] > 0, first["c"]).when(F.col("__n") == 1, first["c"])
    unclear = F.coalesce((second >= 0.45) & (first["r"] - second <= 0.02), F.lit(False))
    return glyphs.select(*keys, glyph).join(got.select(*keys, glyph, chosen.alias(cell), unclear.alias("ambiguous")), [*keys, glyph], "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def column_occupancy(glyphs: DataFrame, tracks: DataFrame, keys: list[str], width: float = 100.0) -> DataFrame:
    """(keys, idx, track): the leftmost track [lo, hi], both ends closed, that holds a glyph's centre."""
    p = glyphs.withColumn("__c", (F.col("x0") + F.col("x1")) / 2).withColumn("__bin", F.floor(F.col("__c") / width).cast("long"))
    t = tracks.withColumn("__bin", F.explode(bins(F.col("lo"), F.col("hi"), width)))
    hit = p.join(t, [*keys, "__bin"]).where(F.col("__c").between(F.col("lo"), F.col("hi")))
    return hit.groupBy(*keys, "idx").agg(F.min(F.struct("lo", "track")).alias("m")).select(*keys, "idx", F.col("m.track").alias("track"))


def rule_coverage(separators: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, covered): the share of each separator [lo, hi] that the union of the rules of its keys covers.

    Keys name the separator's place too, so that few intervals meet.
    """
    m = merged_intervals(rules, keys, "x0", "x1").select(*keys, F.col("lo").alias("__a"), F.col("hi").alias("__b"))
    part = F.greatest(F.lit(0.0), F.least("hi", "__b") - F.greatest("lo", "__a"))
    d = separators.join(m, keys, "left").withColumn("__p", F.coalesce(part, F.lit(0.0)))
    return d.groupBy(*keys, "lo", "hi").agg((F.sum("__p") / (F.col("hi") - F.col("lo"))).alias("covered"))


def visual_rows(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``row``: from the top, a glyph joins the nearest open row that its height overlaps by 0.45 of the smaller, or whose middle is near.

    Near is 0.75 points or 0.4 of the median height, if that is more. A row's
    bounds grow with its members, so the scan is one after another.
    """
    def run(tops: list[float], bottoms: list[float]) -> list[int]:
        heights = sorted([b - a for a, b in zip(tops, bottoms)])
        n = len(heights)
        near = max(0.75, 0.4 * (heights[n // 2] + heights[(n - 1) // 2]) / 2)
        rows: list[list[float]] = []
        out = []
        for top, bottom in zip(tops, bottoms):
            best, least = -1, float("inf")
            for k in range(len(rows) - 1, -1, -1):
                lo, hi = rows[k]
                off = abs((lo + hi) / 2 - (top + bottom) / 2)
                shared = min(hi, bottom) - max(lo, top)
                if (off <= near or shared >= 0.45 * min(hi - lo, bottom - top) > 0) and off < least:
                    best, least = k, off
            if best < 0:
                rows.append([top, bottom])
                best = len(rows) - 1
            else:
                rows[best] = [min(rows[best][0], top), max(rows[best][1], bottom)]
            out.append(best)
        return out

    return per_group(glyphs.withColumn("cy", (F.col("y0") + F.col("y1")) / 2), keys, ["cy", "x0", "idx"], ["y0", "y1"], run, "row", "float64").drop("cy")


def link_spans(chars: DataFrame, links: DataFrame, keys: list[str], width: float = 100.0) -> DataFrame:
    """(keys, link, line, first, last, n): the characters of each line whose centres a link's rectangle (lx0, ly0, lx1, ly1) holds."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    p = chars.withColumn("__bin", F.floor(cx / width).cast("long"))
    r = links.withColumn("__bin", F.explode(bins(F.col("lx0"), F.col("lx1"), width)))
    hit = p.join(r, [*keys, "__bin"]).where(cx.between(F.col("lx0"), F.col("lx1")) & cy.between(F.col("ly0"), F.col("ly1")))
    return hit.groupBy(*keys, "link", "line").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


def ruled_styles(lines: DataFrame, rules: DataFrame, keys: list[str], share: float = 0.6, band: float = 20.0) -> DataFrame:
    """(keys, rule, style, idx): the line that a short rule underlines or strikes: the one it shares most width with, the earlier of equals.

    An underline lies from a tenth of the height above the base to a fifth
    below, a strike within 0.15 of the middle; the rule's ``share`` lies
    along the line. Rules and lines meet by bands of the page.
    """
    l = lines.withColumn("__band", F.explode(bins(F.col("y0"), F.col("y1") + 0.2 * _tall(), band)))
    r = rules.select(*keys, "rule", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), "y").withColumn("__band", F.floor(F.col("y") / band).cast("long"))
    pair = l.join(r, [*keys, "__band"]).withColumn("__w", F.least("x1", "rx1") - F.greatest("x0", "rx0"))
    under = F.col("y").between(F.col("y1") - 0.1 * _tall(), F.col("y1") + 0.2 * _tall())
    strike = F.abs(F.col("y") - (F.col("y0") + F.col("y1")) / 2) <= 0.15 * _tall()
    pair = pair.withColumn("style", F.when(under, "underline").when(strike, "strikethrough")).where(F.col("style").isNotNull() & (F.col("__w") >= share * (F.col("rx1") - F.col("rx0"))))
    best = pair.groupBy(*keys, "rule").agg(F.max_by(F.struct("style", "idx"), F.struct("__w", -F.col("idx"))).alias("m"))
    return best.select(*keys, "rule", F.col("m.style").alias("style"), F.col("m.idx").alias("idx"))


def stacked_tiles(tiles: DataFrame, keys: list[str], touch: float = 1.0) -> DataFrame:
    """(keys, x0, x1, y0, y1, n): pictures of one rounded width and place that follow one another downwards, at least two, as one."""
    d = tiles.withColumn("__l", F.round("x0")).withColumn("__r", F.round("x1"))
    w = Window.partitionBy(*keys, "__l", "__r").orderBy("y0", "y1")
    end = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__t", F.sum(F.when(F.col("y0") - end <= touch, 0).otherwise(1)).over(w))
    g = d.groupBy(*keys, "__l", "__r", "__t").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").drop("__l", "__r", "__t")


def bar_charts(rects: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, base, width, n, x0, y0, x1): at least ``least`` bars of one width on one base line, of different heights."""
    d = rects.withColumn("base", F.round("y1")).withColumn("width", F.round(_wide()))
    g = d.groupBy(*keys, "base", "width").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round(_tall())).alias("__h"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"))
    return g.where((F.col("n") >= least) & (F.col("__h") > 1)).drop("__h")


def stacked_columns(rects: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, left, right, n, top, bottom): rectangles of one place sideways that stand on one another, at least ``least``."""
    d = rects.withColumn("left", F.round("x0")).withColumn("right", F.round("x1"))
    w = Window.partitionBy(*keys, "left", "right").orderBy("y0", "y1")
    joined = F.abs(F.col("y0") - F.lag("y1").over(w)) <= 1
    d = d.withColumn("__t", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    g = d.groupBy(*keys, "left", "right", "__t").agg(F.count(F.lit(1)).alias("n"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    return g.where(F.col("n") >= least).drop("__t")


def equal_steps(ticks: DataFrame, keys: list[str], value: str, least: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """(keys, n, step): tick labels from the top whose values all change by one step that isn't 0: an axis."""
    w = Window.partitionBy(*keys).orderBy("y0", "idx")
    d = ticks.withColumn("__d", F.col(value) - F.lag(value).over(w))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__d").alias("step"), F.max("__d").alias("__m"))
    return g.where((F.col("n") >= least) & (F.col("__m") - F.col("step") <= tolerance) & (F.col("step") != 0)).drop("__m")


def crossing_axes(across: DataFrame, down: DataFrame, keys: list[str], long: float, tolerance: float, width: float = 100.0) -> DataFrame:
    """(keys, h, v): long horizontal (x0, x1, y) and vertical (x, y0, y1) rules that meet near the left end of one and the foot of the other."""
    a = across.where(_wide() >= long).select(*keys, F.col("idx").alias("h"), F.col("x0").alias("__x"), F.col("y").alias("__y"))
    a = a.withColumn("__bin", F.explode(bins(F.col("__x") - tolerance, F.col("__x") + tolerance, width)))
    b = down.where(_tall() >= long).select(*keys, F.col("idx").alias("v"), "x", "y1").withColumn("__bin", F.floor(F.col("x") / width).cast("long"))
    near = (F.abs(F.col("x") - F.col("__x")) <= tolerance) & (F.abs(F.col("y1") - F.col("__y")) <= tolerance)
    return a.join(b, [*keys, "__bin"]).where(near).select(*keys, "h", "v")


def touching(boxes: DataFrame, keys: list[str], idx: str, reach: float, width: float = 100.0) -> DataFrame:
    """(keys, i, j): boxes i < j that meet when grown by ``reach`` on all sides; boxes meet by bins sideways."""
    own = boxes.select(*keys, F.col(idx).alias("i"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("__bin", F.explode(bins(F.col("a_x0") - reach, F.col("a_x1") + reach, width)))
    other = boxes.select(*keys, F.col(idx).alias("j"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("__bin", F.explode(bins(F.col("b_x0"), F.col("b_x1"), width)))
    meets = (F.col("a_x0") - reach <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1") + reach) & (F.col("a_y0") - reach <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1") + reach)
    return own.join(other, [*keys, "__bin"]).where((F.col("i") < F.col("j")) & meets).select(*keys, "i", "j").distinct()


def drawings(boxes: DataFrame, keys: list[str], name: Column, reach: float, least: int = 2) -> DataFrame:
    """(component, n, x0, y0, x1, y1): boxes and connectors that touch within ``reach``, at least ``least``, as one drawing.

    ``name`` is a box's number over all pages; a component's is its least.
    """
    b = boxes.withColumn("__name", name)
    pairs = touching(b, keys, "__name", reach)
    comp = connected_components(pairs, "i", "j")
    g = b.join(comp, F.col("__name") == F.col("node")).groupBy("component")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where(F.col("n") >= least)


def complex_drawings(paths: DataFrame, keys: list[str], least: int, curved: float) -> DataFrame:
    """(keys, segments, curves): pages whose paths have at least ``least`` segments, ``curved`` of them curves."""
    g = paths.groupBy(*keys).agg(F.sum("segments").cast("long").alias("segments"), F.sum("curves").cast("long").alias("curves"))
    return g.where((F.col("segments") >= least) & (F.col("curves") >= curved * F.col("segments")))


def formula_anchors(lines: DataFrame, keys: list[str], reach: float = 20.0) -> DataFrame:
    """(keys, idx, number): equation numbers in brackets that end near the right edge of their lane."""
    d = lines.withColumn("__right", F.max("x1").over(Window.partitionBy(*keys))).withColumn("number", F.regexp_extract("text", r"^\((\d+(?:\.\d+)*[a-z]?)\)$", 1))
    return d.where((F.col("number") != "") & (F.col("__right") - F.col("x1") <= reach)).select(*keys, "idx", "number")


def repeated_anchors(anchors: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, right, n): right edges (rounded) at which at least ``least`` equation numbers end."""
    g = anchors.groupBy(*keys, F.round("x1").alias("right")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least)


def unclaimed(items: DataFrame, regions: DataFrame, keys: list[str], width: float = 100.0) -> DataFrame:
    """Items whose centre lies in none of the regions (cx0, cy0, cx1, cy1) of their page."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    p = items.select(*keys, "idx", x.alias("__x"), y.alias("__y")).withColumn("__bin", F.floor(F.col("__x") / width).cast("long"))
    r = regions.withColumn("__bin", F.explode(bins(F.col("cx0"), F.col("cx1"), width)))
    taken = p.join(r, [*keys, "__bin"]).where(F.col("__x").between(F.col("cx0"), F.col("cx1")) & F.col("__y").between(F.col("cy0"), F.col("cy1")))
    return items.join(taken.select(*keys, "idx").distinct(), [*keys, "idx"], "left_anti")


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether two texts are equal up to an edit distance of 1 - ``least`` of the longer one."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.levenshtein(a, b) <= (1 - least) * longer


def hidden_copies(hidden: DataFrame, visible: DataFrame, keys: list[str], least: int = 6, share: float = 0.85, band: float = 50.0) -> DataFrame:
    """(keys, i, j): hidden texts (idx) over visible ones (jdx, vx0, vy0, vx1, vy1, vtext) that say the same; both of ``least`` characters.

    Rows meet by bands of the page that both touch.
    """
    h = hidden.where(F.length("text") >= least).withColumn("__band", F.explode(bins(F.col("y0"), F.col("y1"), band)))
    v = visible.where(F.length("vtext") >= least).withColumn("__band", F.explode(bins(F.col("vy0"), F.col("vy1"), band)))
    meets = (F.col("x0") < F.col("vx1")) & (F.col("vx0") < F.col("x1")) & (F.col("y0") < F.col("vy1")) & (F.col("vy0") < F.col("y1"))
    return h.join(v, [*keys, "__band"]).where(meets & similar(F.col("text"), F.col("vtext"), share)).select(*keys, F.col("idx").alias("i"), F.col("jdx").alias("j")).distinct()


def latest_by_page(batches: DataFrame, doc: str, page: str, batch: str, values: list[str]) -> DataFrame:
    """(doc, page, values): of several batches' rows for a page those of the latest batch."""
    best = batches.groupBy(doc, page).agg(F.max_by(F.struct(*values), F.col(batch)).alias("v"))
    return best.select(doc, page, *[F.col(f"v.{x}").alias(x) for x in values])


def with_blank_pages(pages: DataFrame, counts: DataFrame, doc: str, page: str) -> DataFrame:
    """``pages`` with a row of nulls for each page number below the document's count (doc, n) that has none."""
    every = counts.where("n > 0").select(doc, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias(page))
    return pages.unionByName(every.select(doc, F.col(page).cast(pages.schema[page].dataType)).join(pages.select(doc, page).distinct(), [doc, page], "left_anti"), allowMissingColumns=True)


def totals(df: DataFrame, keys: list[str], measures: list[Column], how: str = "cube") -> DataFrame:
    """Measures for all combinations of the keys (``cube``) or for each leading part of them (``rollup``); ``level`` tells the sums apart."""
    g = df.cube(*keys) if how == "cube" else df.rollup(*keys)
    return g.agg(F.grouping_id(*keys).alias("level"), *measures)


def row_signatures(cells: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """(keys, row, n, wide, colspans, texts): a row's cells in order: their number, all columns, spans and texts without white space."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(col), F.col("colspan"), F.regexp_replace("text", r"\s+", "").alias("t"))))
    g = cells.groupBy(*keys, row).agg(parts.alias("p"), F.sum("colspan").cast("long").alias("wide"))
    return g.select(*keys, row, F.size("p").alias("n"), "wide", F.transform("p", lambda x: x["colspan"]).alias("colspans"), F.transform("p", lambda x: x["t"]).alias("texts"))


def exact_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, total, mean): sums without rounding on the way: over decimals of eight places, whatever the order of the rows."""
    d = F.col(value).cast("decimal(28,8)")
    return df.groupBy(*keys).agg(F.sum(d).cast("double").alias("total"), (F.sum(d).cast("double") / F.count(d)).alias("mean"))


def repeated_siblings(items: DataFrame, parent: str, sign: str, longest: int) -> DataFrame:
    """(parent, penalty): for short siblings that share a sign, how many there are beyond two."""
    g = items.where(F.length("text") <= longest).groupBy(parent, sign).agg(F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).alias("n"))
    return g.groupBy(parent).agg(F.sum("n").alias("penalty"))
