"""Rules on the placed lines of pages: profiles, runs, rows, neighbours, notes, titles.

Lines have ``keys`` (document, page, lane), ``idx`` and the sides x0, y0, x1,
y1 in points, with font, bold and text where a rule needs them. A page's
lines are few; rows meet only within their keys, mostly by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.relational import weighted_mode

#: Marks that end a sentence, bullets, and what opens a line that stands alone.
SENTENCE_END, BULLET = r"[.!?。！？]$", r"^[•‣▪●○◦]\s"
MAIL = r"^(From|To|Cc|Date|Subject|Sent):"
NOTE_START = r"^(\[?\d{1,3}\]?|[*†‡§])\s"


def _tall() -> Column:
    return F.col("y1") - F.col("y0")


def _wide() -> Column:
    return F.col("x1") - F.col("x0")


def ordered(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("y0", "x0", "idx")


def typography(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, font, coverage, bold_share): the font of most characters, its share of them, and the share in bold."""
    n = F.length("text")
    top = weighted_mode(lines, keys, "font", n).select(*keys, F.col("mode").alias("font"), F.col("weight").alias("__w"))
    every = lines.groupBy(*keys).agg(F.sum(n).alias("__n"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("__b"))
    share = lambda c: F.when(F.col("__n") > 0, F.col(c) / F.col("__n"))
    return every.join(top, keys).select(*keys, "font", share("__w").alias("coverage"), share("__b").alias("bold_share"))


def lane_profile(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, font, bold_share): the median height, the font of most width, and the width's share in bold."""
    top = weighted_mode(lines, keys, "font", _wide()).select(*keys, F.col("mode").alias("font"))
    agg = lines.groupBy(*keys).agg(F.median(_tall()).alias("height"), (F.sum(F.when(F.col("bold"), _wide()).otherwise(0.0)) / F.sum(_wide())).alias("bold_share"))
    return agg.join(top, keys).select(*keys, "height", "font", "bold_share")


def lane_gap(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, regular, mad): the usual white space between a lane's lines.

    Of the gaps between lines that overlap sideways and whose heights differ
    by at most 1.35 times, those from -0.25 to 2 median heights count; the
    median of the smallest 60 % (rounded up) is regular, with the median
    distance from it. Without gaps it is 0.35 of the median height.
    """
    d = lines.withColumn("__h", _tall())
    for c in ("x0", "x1", "y1", "__h"):
        d = d.withColumn(f"__p_{c}", F.lag(c).over(ordered(keys)))
    heights = lines.groupBy(*keys).agg(F.median(_tall()).alias("height"))
    fits = (F.greatest("__h", "__p___h") <= 1.35 * F.least("__h", "__p___h")) & (F.least("x1", "__p_x1") > F.greatest("x0", "__p_x0"))
    d = d.where(fits).join(heights, keys).withColumn("__gap", F.col("y0") - F.col("__p_y1"))
    d = d.where(F.col("__gap").between(-0.25 * F.col("height"), 2 * F.col("height")))
    by = Window.partitionBy(*keys)
    d = d.withColumn("__k", F.row_number().over(by.orderBy("__gap", "idx"))).withColumn("__n", F.count(F.lit(1)).over(by))
    some = d.where(F.col("__k") <= F.ceil(F.col("__n") * 0.6)).withColumn("__regular", F.median("__gap").over(by))
    got = some.groupBy(*keys).agg(F.first("__regular").alias("regular"), F.median(F.abs(F.col("__gap") - F.col("__regular"))).alias("mad"))
    return heights.join(got, keys, "left").select(*keys, "height", F.coalesce("regular", 0.35 * F.col("height")).alias("regular"), F.coalesce("mad", F.lit(0.0)).alias("mad"))


def paragraphs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``paragraph`` (from 1): a line joins the one above if their fonts agree, their heights are alike, the gap is usual and it isn't indented."""
    w = ordered(keys)
    d = lines.join(lane_gap(lines, keys), keys)
    for c in ("x0", "y1", "font"):
        d = d.withColumn(f"__p_{c}", F.lag(c).over(w))
    d = d.withColumn("__p_h", F.lag(_tall()).over(w))
    joins = (
        (F.col("font") == F.col("__p_font")) & (F.greatest(_tall(), F.col("__p_h")) <= 1.35 * F.least(_tall(), F.col("__p_h")))
        & (F.col("y0") - F.col("__p_y1") <= F.col("regular") + 3 * F.col("mad") + 0.1 * F.col("height")) & (F.col("x0") - F.col("__p_x0") < 0.8 * F.col("height"))
    )
    d = d.withColumn("paragraph", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return d.drop("height", "regular", "mad", "__p_x0", "__p_y1", "__p_font", "__p_h")


def baseline_runs(runs: DataFrame, keys: list[str], tolerance: float, widest: float) -> DataFrame:
    """(keys, baseline, run, text, x0, y0, x1, y1, n): runs of one rounded baseline, at most ``widest`` heights apart, as one line."""
    d = runs.withColumn("baseline", F.floor(F.col("y1") / tolerance).cast("long"))
    w = Window.partitionBy(*keys, "baseline").orderBy("x0", "idx")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("run", F.sum(F.when(F.col("x0") - reach <= widest * _tall(), 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "idx", "text"))), lambda x: x["text"])
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return d.groupBy(*keys, "baseline", "run").agg(F.array_join(parts, " ").alias("text"), *sides, F.count(F.lit(1)).alias("n"))


def same_baseline_pairs(lines: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, i, j): lines i < j whose baselines are at most ``tolerance`` apart; rows meet by the band of the baseline."""
    band = F.floor(F.col("y1") / tolerance).cast("long")
    a = lines.select(*keys, F.col("idx").alias("i"), F.col("y1").alias("__a"), band.alias("__band"))
    b = lines.select(*keys, F.col("idx").alias("j"), F.col("y1").alias("__b"), F.explode(F.array(band - 1, band, band + 1)).alias("__band"))
    return a.join(b, [*keys, "__band"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("__a") - F.col("__b")) <= tolerance)).select(*keys, "i", "j")


def line_above(lines: DataFrame, keys: list[str], reach: float = 200.0) -> DataFrame:
    """(keys, idx, above, distance): the nearest line that ends above a line and overlaps it sideways; the earlier wins a tie.

    Lines meet by bands of ``reach`` points, beyond which a line is no neighbour.
    """
    band = F.floor(F.col("y0") / reach).cast("long")
    own = lines.select(*keys, "idx", "x0", "x1", F.col("y0").alias("__top"), band.alias("__band"))
    ends = F.floor(F.col("y1") / reach).cast("long")
    other = lines.select(*keys, F.col("idx").alias("above"), F.col("x0").alias("__x0"), F.col("x1").alias("__x1"), F.col("y1").alias("__end"), F.explode(F.array(ends, ends + 1)).alias("__band"))
    near = own.join(other, [*keys, "__band"]).withColumn("distance", F.col("__top") - F.col("__end"))
    near = near.where((F.col("idx") != F.col("above")) & F.col("distance").between(0, reach) & (F.least("x1", "__x1") > F.greatest("x0", "__x0")))
    best = near.groupBy(*keys, "idx").agg(F.min(F.struct("distance", "above")).alias("m"))
    return best.select(*keys, "idx", F.col("m.above").alias("above"), F.col("m.distance").alias("distance"))


def hanging_groups(lines: DataFrame, keys: list[str], least: float = 6.0) -> DataFrame:
    """Adds ``entry``: a line that protrudes to the left of the lane's usual edge opens an entry, where at least two lines do."""
    edges = weighted_mode(lines, keys, "x0", F.lit(1)).select(*keys, F.col("mode").alias("__edge"))
    d = lines.join(edges, keys).withColumn("__out", F.col("x0") <= F.col("__edge") - least)
    d = d.withColumn("__many", F.sum(F.col("__out").cast("int")).over(Window.partitionBy(*keys)) >= 2)
    return d.withColumn("entry", F.sum((F.col("__out") & F.col("__many")).cast("int")).over(ordered(keys))).drop("__edge", "__out", "__many")


def prose_breaks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx): lines before which a paragraph ends: the line above ends a sentence and leaves room for this one's first word."""
    w = ordered(keys)
    first = F.regexp_extract("text", r"^\S+", 0)
    wide = _wide() * F.length(first) / F.length("text")
    d = lines.where(F.length("text") > 0).withColumn("__right", F.max("x1").over(Window.partitionBy(*keys)))
    d = d.withColumn("__pt", F.lag("text").over(w)).withColumn("__px", F.lag("x1").over(w))
    return d.where(F.col("__pt").rlike(SENTENCE_END) & (F.col("__px") + wide < F.col("__right"))).select(*keys, "idx")


def bullet_breaks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx): lines that open with a bullet, where at least two do at the same left edge."""
    d = lines.where(F.col("text").rlike(BULLET)).withColumn("__x", F.round("x0"))
    return d.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__x"))).where("__n >= 2").select(*keys, "idx")


def explicit_breaks(lines: DataFrame, keys: list[str], marker: Column) -> DataFrame:
    """(keys, idx): lines that stand alone by their words: an e-mail's fields, or ``marker`` (a list marker's kind) where it isn't null."""
    return lines.where(F.col("text").rlike(MAIL) | marker.isNotNull()).select(*keys, "idx")


def counted_breaks(lines: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """(keys, idx): lines whose entry number is one more than the last numbered line's, or one less than the next one's."""
    w = ordered(keys)
    d = lines.withColumn("__v", number).where("__v is not null")
    d = d.withColumn("__next", (F.col("__v") == F.lag("__v").over(w) + 1) | (F.col("__v") == F.lead("__v").over(w) - 1))
    return d.where("__next").select(*keys, "idx")


def lettered_lists(lines: DataFrame, keys: list[str], number: Column, least: int = 2) -> DataFrame:
    """(keys, first, n): runs of lines whose numbers go up by one, at least ``least`` of them."""
    w = ordered(keys)
    d = lines.withColumn("__v", number).withColumn("__k", F.row_number().over(w)).where("__v is not null").withColumn("__run", F.col("__v") - F.col("__k"))
    return d.groupBy(*keys, "__run").agg(F.min("__k").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("__run")


def aside_text(lines: DataFrame, page_width: Column, margin: float = 0.08) -> DataFrame:
    """Lines that stand upright in a side margin."""
    centre = (F.col("x0") + F.col("x1")) / 2
    return lines.where((_tall() > 3 * _wide()) & ((centre < margin * page_width) | (centre > (1 - margin) * page_width)))


def ruled_margin(lines: DataFrame, rules: DataFrame, keys: list[str], height: float, header: bool, wide: float, share: float = 0.15) -> DataFrame:
    """(keys, idx): header lines over a rule of at least ``wide`` points in the page's top ``share`` (or footer lines under one at its foot)."""
    at = F.min("y") if not header else F.max("y")
    band = F.col("y") <= share * height if header else F.col("y") >= (1 - share) * height
    one = rules.where((F.col("x1") - F.col("x0") >= wide) & band).groupBy(*keys).agg(at.alias("__y"))
    d = lines.join(one, keys)
    return d.where(F.col("y1") <= F.col("__y") if header else F.col("y0") >= F.col("__y")).select(*keys, "idx")


def repeated_pictures(images: DataFrame, doc: str, page: str, least: int = 3) -> DataFrame:
    """(doc, x0, y0, x1, y1, n_pages): picture places (rounded) that at least ``least`` pages of a document share."""
    sides = [F.round(c).alias(c) for c in ("x0", "y0", "x1", "y1")]
    d = images.select(doc, page, *sides).distinct()
    return d.groupBy(doc, "x0", "y0", "x1", "y1").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least)


def watermarks(images: DataFrame, doc: str, page: str, mark: str, page_area: Column, least: int = 3, large: float = 0.5) -> DataFrame:
    """(doc, mark, n_pages): fingerprints of pictures that cover at least ``large`` of the page, on at least ``least`` pages."""
    big = images.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= large * page_area)
    return big.select(doc, page, mark).distinct().groupBy(doc, mark).agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= least)


def header_separators(rules: DataFrame, evidence: DataFrame, doc: str, page: str, least: int = 3, sure: int = 2) -> DataFrame:
    """(doc, x0, x1, y, n_pages): rules of one rounded place on at least ``least`` pages, ``sure`` of them with evidence of a header."""
    sign = [F.round(c).alias(c) for c in ("x0", "x1", "y")]
    d = rules.select(doc, page, *sign).distinct().join(evidence.select(doc, page).distinct().withColumn("__e", F.lit(1)), [doc, page], "left")
    g = d.groupBy(doc, "x0", "x1", "y").agg(F.count(F.lit(1)).alias("n_pages"), F.count("__e").alias("__sure"))
    return g.where((F.col("n_pages") >= least) & (F.col("__sure") >= sure)).drop("__sure")


def page_footnotes(lines: DataFrame, rules: DataFrame, keys: list[str], height: float, small: float = 0.92) -> DataFrame:
    """(keys, idx): small lines under the last rule of the page's lower half; small is under ``small`` of its median height."""
    last = rules.where(F.col("y") >= height / 2).groupBy(*keys).agg(F.max("y").alias("__y"))
    mid = lines.groupBy(*keys).agg(F.median(_tall()).alias("__h"))
    return lines.join(last, keys).join(mid, keys).where((F.col("y0") >= F.col("__y")) & (_tall() < small * F.col("__h"))).select(*keys, "idx")


def note_entries(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entry, text): notes as entries that a mark or number opens; lines before the first mark are entry 0."""
    d = lines.withColumn("entry", F.sum(F.col("text").rlike(NOTE_START).cast("int")).over(ordered(keys)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "idx", "text"))), lambda x: x["text"])
    return d.groupBy(*keys, "entry").agg(F.array_join(parts, " ").alias("text"))


def note_height(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height): the median of the tallest quarter (rounded up) of the heights."""
    by = Window.partitionBy(*keys)
    d = lines.withColumn("__h", _tall()).withColumn("__k", F.row_number().over(by.orderBy(F.desc("__h"), "idx"))).withColumn("__n", F.count(F.lit(1)).over(by))
    return d.where(F.col("__k") <= F.ceil(F.col("__n") / 4)).groupBy(*keys).agg(F.median("__h").alias("height"))


def index_lanes(lines: DataFrame, keys: list[str], least: int = 3, share: float = 0.5) -> DataFrame:
    """(keys, n, share): lanes in which page numbers end enough lines to be a table of contents."""
    tail = F.col("text").rlike(r"(\.{2,}|\s)\s*\d{1,4}$").cast("int")
    g = lines.groupBy(*keys).agg(F.sum(tail).alias("n"), F.avg(tail.cast("double")).alias("share"))
    return g.where((F.col("n") >= least) & (F.col("share") >= share))


def page_number_runs(marks: DataFrame, doc: str, page: str, value: str, reach: int = 2) -> DataFrame:
    """(doc, page, value): numbers that grow as the pages do, within ``reach`` pages of another such number."""
    near = marks.select(doc, F.explode(F.array(*[F.col(page) + k for k in range(-reach, reach + 1) if k])).alias(page), F.col(page).alias("__q"), F.col(value).alias("__v"))
    hit = marks.join(near, [doc, page]).where(F.col(value) - F.col("__v") == F.col(page) - F.col("__q"))
    return hit.select(doc, page, value).distinct()


def reference_regions(lines: DataFrame, keys: list[str], opens: Column, closes: Column) -> DataFrame:
    """Adds ``in_references``: whether the last line at or before this one that opens or closes a list of references opened one."""
    state = F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(ordered(keys).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("in_references", F.coalesce(state, F.lit(0)) == 1)


def following(lines: DataFrame, keys: list[str], kind: str, most: int = 5) -> DataFrame:
    """Adds ``following``: the indices of the next lines of the same kind, at most ``most``, up to the first of another kind."""
    w = ordered(keys)
    d = lines.withColumn("__epoch", F.sum(F.when(F.col(kind) == F.lag(kind).over(w), 0).otherwise(1)).over(w))
    ahead = Window.partitionBy(*keys, "__epoch").orderBy("y0", "x0", "idx").rowsBetween(1, most)
    return d.withColumn("following", F.collect_list("idx").over(ahead)).drop("__epoch")


def document_title(lines: DataFrame, keys: list[str], page_height: float, ratio: float = 1.2) -> DataFrame:
    """(keys, idx, text): the tallest line of the upper half, the topmost of equals, if it is ``ratio`` times the median height."""
    mid = lines.groupBy(*keys).agg(F.median(_tall()).alias("__mid"))
    d = lines.where(F.col("y0") < page_height / 2).withColumn("__h", _tall())
    best = d.groupBy(*keys).agg(F.max_by(F.struct("idx", "text", "__h"), F.struct("__h", -F.col("y0"), -F.col("idx"))).alias("m"))
    return best.join(mid, keys).where(F.col("m.__h") >= ratio * F.col("__mid")).select(*keys, F.col("m.idx").alias("idx"), F.col("m.text").alias("text"))


def lane_titles(lines: DataFrame, keys: list[str], most_words: int = 12, least: int = 3) -> DataFrame:
    """(keys, idx, score): titles by points: 2 for a height 1.15 times the lane's, 1 each for bold, another font, no sentence end, few words."""
    d = lines.join(lane_profile(lines, keys).select(*keys, F.col("height").alias("__h"), F.col("font").alias("__f")), keys)
    point = lambda c, n=1: F.when(c, n).otherwise(0)
    few = F.size(F.split(F.trim("text"), r"\s+")) <= most_words
    score = point(_tall() >= 1.15 * F.col("__h"), 2) + point(F.col("bold")) + point(F.col("font") != F.col("__f")) + point(~F.col("text").rlike(SENTENCE_END)) + point(few)
    return d.withColumn("score", score).where(F.col("score") >= least).select(*keys, "idx", "score")


def demoted_titles(lines: DataFrame, keys: list[str], title: str) -> DataFrame:
    """(keys, idx): lines marked as titles that go on from an open sentence: the line above is no title and ends none."""
    w = ordered(keys)
    above, was = F.lag("text").over(w), F.lag(title).over(w)
    d = lines.withColumn("__open", ~above.rlike(SENTENCE_END) & ~was)
    return d.where(F.col(title) & F.col("__open")).select(*keys, "idx")


def numbered_titles(lines: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """(keys, idx, depth): short lines that a section number opens and no sentence mark ends."""
    number = F.regexp_extract("text", r"^(\d{1,3}(?:\.\d{1,3}){0,5})\.?\s+\S", 1)
    d = lines.withColumn("__n", number).where((F.col("__n") != "") & (F.length("text") <= most) & ~F.col("text").rlike(SENTENCE_END))
    return d.select(*keys, "idx", F.size(F.split("__n", r"\.")).alias("depth"))


def recurrent_styles(lines: DataFrame, doc: str, page: str, share: float = 0.2, pages: int = 2) -> DataFrame:
    """(doc, font, bold, height, n): styles of few lines (under ``share`` of the document's) that come on at least ``pages`` pages."""
    d = lines.withColumn("height", F.round(_tall()))
    g = d.groupBy(doc, "font", "bold", "height").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(page).alias("__p"))
    every = F.sum("n").over(Window.partitionBy(doc))
    return g.withColumn("__n", every).where((F.col("__p") >= pages) & (F.col("n") < share * F.col("__n"))).select(doc, "font", "bold", "height", "n")


def body_sections(lines: DataFrame, keys: list[str], short: float = 0.6, long: float = 0.9, least: int = 2) -> DataFrame:
    """(keys, idx): short lines before a nearly full one, where a lane has at least ``least`` such pairs."""
    by = Window.partitionBy(*keys)
    d = lines.withColumn("__w", _wide()).withColumn("__full", F.max(_wide()).over(by)).withColumn("__next", F.lead(_wide()).over(ordered(keys)))
    d = d.where((F.col("__w") <= short * F.col("__full")) & (F.col("__next") >= long * F.col("__full")) & ~F.col("text").rlike(SENTENCE_END))
    return d.withColumn("__n", F.count(F.lit(1)).over(by)).where(F.col("__n") >= least).select(*keys, "idx")


def typography_resets(lines: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """(keys, idx): lines of at most ``most`` words in a font that the lines before and after, which share one, don't have."""
    w = ordered(keys)
    d = lines.withColumn("__b", F.lag("font").over(w)).withColumn("__a", F.lead("font").over(w))
    few = F.size(F.split(F.trim("text"), r"\s+")) <= most
    return d.where((F.col("__a") == F.col("__b")) & (F.col("font") != F.col("__a")) & few).select(*keys, "idx")


def font_counts(chars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, font, n, generated, cjk): characters by font, of them generated ones and CJK ones."""
    cjk = F.col("char").rlike(r"^[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}]")
    return chars.groupBy(*keys, "font").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("generated")).alias("generated"), F.count_if(cjk).alias("cjk"))


def runs_by(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, first, last, value, n): runs of rows with one value, nulls alike: writing angles, mapped objects, marks."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    d = rows.withColumn("__r", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return d.groupBy(*keys, "__r").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias(value), F.count(F.lit(1)).alias("n")).drop("__r")


def visual_runs(chars: DataFrame, keys: list[str], widest: float) -> DataFrame:
    """(keys, run, x0, x1, n): characters of a line split where the white space is over ``widest`` times the mean width so far apart."""
    w = Window.partitionBy(*keys).orderBy("x0", "idx")
    mean = F.avg(_wide()).over(Window.partitionBy(*keys))
    d = chars.withColumn("run", F.sum(F.when(F.col("x0") - F.lag("x1").over(w) <= widest * mean, 0).otherwise(1)).over(w))
    return d.groupBy(*keys, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def marginal_order(blocks: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Adds ``position``: headers from the top first, then the body by its index, footers and page numbers last."""
    rank = F.when(F.col(kind) == "header", 0).when(F.col(kind).isin("footer", "page_number"), 2).otherwise(1)
    w = Window.partitionBy(*keys).orderBy(rank, F.when(rank == 1, 0.0).otherwise(F.col("y0")), F.when(rank == 1, 0.0).otherwise(F.col("x0")), "idx")
    return blocks.withColumn("position", F.row_number().over(w) - 1)


def equation_order(blocks: DataFrame, keys: list[str], number: Column, tolerance: float) -> DataFrame:
    """Adds ``position``: bands of the page from the top, and in a band an equation's number after its body."""
    band = F.floor(F.col("y0") / tolerance)
    w = Window.partitionBy(*keys).orderBy(band, number.cast("int"), "x0", "idx")
    return blocks.withColumn("position", F.row_number().over(w) - 1)
