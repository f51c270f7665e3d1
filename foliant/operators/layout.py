"""Page layout: reading order, one-dimensional clusters, repeated margins, paragraphs that go on."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from foliant.functions import bbox
from foliant.functions.text import marginal_key
from foliant.operators.relational import interval_join, last_behind_barrier
from foliant.plans.shared import group_codes, whole_groups

# Marks after which a paragraph is over.
STOP_MARKS = ".!?。！？)）\"”:：;；"
#: Shares of the page height of the header and footer bands, and how far a repeated line may move or grow.
HEADER, FOOTER, SHIFT, GROWTH = 0.15, 0.90, 0.025, 1.35


def per_group(df: DataFrame, keys: list[str], order: list[str], values: list[str], fn: Callable[..., list[int]], out: str, dtype: str | None = None) -> DataFrame:
    """Adds the whole numbers that ``fn`` gives for the lists of ``values`` (as ``dtype``) of each group's rows, in ``order``.

    Groups are runs of a sorted partition, taken from tables that hold some
    thousand rows of whole groups: a small group costs no more than its rows.
    """
    schema = StructType([*df.schema.fields, StructField(out, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, 8192):
            new = np.zeros(len(table) - 1, bool)
            for k in keys:
                codes = group_codes(table, k)
                new |= codes[1:] != codes[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(table)]
            columns = [np.asarray(table.column(v).to_numpy(), dtype).tolist() for v in values]
            got: list[int] = []
            for lo, hi in zip(cuts, cuts[1:]):
                got += fn(*[c[lo:hi] for c in columns])
            yield from table.append_column(out, pa.array(got, pa.int32())).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def clusters(df: DataFrame, keys: list[str], value: str, tolerance: float, relative: bool = False) -> DataFrame:
    """Adds ``cluster``: sorted values, each in the open cluster if it is within the tolerance of that cluster's median.

    The median moves as a cluster grows, so the scan is sequential within a
    key; it goes over the different values with their counts, so its memory
    is that of a key's different values, not of its rows. Equal values share
    a cluster: once one has joined, the median only comes nearer to them.
    """
    def run(found: list[float], counts: list[int]) -> list[int]:
        labels: list[int] = []
        values: list[float] = []
        upto: list[int] = []
        label = -1
        for v, n in zip(found, counts):
            total = upto[-1] if upto else 0
            if total:
                mid = (values[bisect_right(upto, (total - 1) // 2)] + values[bisect_right(upto, total // 2)]) / 2
            if not total or abs(v - mid) > (tolerance * abs(mid) if relative else tolerance):
                values, upto, total, label = [], [], 0, label + 1
            values.append(v)
            upto.append(total + n)
            labels.append(label)
        return labels

    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    named = per_group(counts, keys, [value], [value, "__n"], run, "cluster").drop("__n")
    other = named.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__value"), "cluster")
    same = F.col(value).eqNullSafe(F.col("__value"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(other, same).drop("__value", *[f"__k_{k}" for k in keys])


# Fixed values of the reading order: a wide box by the median width, the share of a dense region, the least white gap in points,
# the least sideways overlap and number of boxes that a wide one spans, and the share of a region's width up to which a box is narrow.
WIDE, DENSE, WHITE, SPANNED, SPANS, NARROW = 1.3, 0.9, 5.0, 0.1, 2, 0.1
#: Boxes up to which a region is ordered without arrays: for few boxes these cost more than the work on them.
FEW = 64


def _white(lo: np.ndarray, hi: np.ndarray) -> tuple[float, float]:
    """(width, middle) of the widest white gap between intervals on one axis, the first of equals."""
    if len(lo) < 2:
        return 0.0, 0.0
    by = np.lexsort((hi, lo))
    reach, start = np.maximum.accumulate(hi[by])[:-1], lo[by][1:]
    k = int(np.argmax(start - reach))
    return max(0.0, float(start[k] - reach[k])), float(start[k] + reach[k]) / 2


def _white_few(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """``_white`` of few intervals."""
    if len(spans) < 2:
        return 0.0, 0.0
    spans = sorted(spans)
    reach, best, at = spans[0][1], float("-inf"), 0.0
    for lo, hi in spans[1:]:
        if lo - reach > best:
            best, at = lo - reach, (lo + reach) / 2
        if hi > reach:
            reach = hi
    return max(0.0, best), at


def _few(x0: list[float], y0: list[float], x1: list[float], y1: list[float]) -> list[int]:
    """``xy_cut`` of few boxes, step by step the same."""
    width = [b - a for a, b in zip(x0, x1)]

    def from_top(ids: list[int]) -> list[int]:
        return sorted(ids, key=lambda i: (y0[i], x0[i], i))

    def region(ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        wide: list[int] = []
        if n > 2:
            sizes = sorted([width[i] for i in ids])
            bar = WIDE * ((sizes[(n - 1) // 2] + sizes[n // 2]) / 2)
            for i in ids if sizes[-1] >= bar else ():
                if width[i] >= bar:
                    a, b, w = x0[i], x1[i], width[i]
                    if sum([min(x1[j], b) - max(x0[j], a) >= SPANNED * min(width[j], w) for j in ids]) - 1 >= SPANS:
                        wide.append(i)
        if not wide:
            return cut(ids)
        across = set(wide)
        wide, rest = from_top(wide), [i for i in ids if i not in across]
        starts, bands = [y0[i] for i in wide], [[] for _ in range(len(wide) + 1)]
        for i in cut(rest):
            bands[bisect_left(starts, y1[i])].append(i)
        out = bands[0]
        for i, band in zip(wide, bands[1:]):
            out += [i, *band]
        return out

    def cut(ids: list[int]) -> list[int]:
        if len(ids) < 2:
            return ids
        xs, ys = [(x0[i], x1[i]) for i in ids], [(y0[i], y1[i]) for i in ids]
        left, top, right, bottom = min(xs)[0], min(ys)[0], max([b for _, b in xs]), max([b for _, b in ys])
        rows, columns = _white_few(ys), _white_few(xs)
        if columns[0] < WHITE and len(ids) > 2:
            broad = [v for v in xs if v[1] - v[0] >= NARROW * (right - left)]
            if 2 <= len(broad) < len(ids):
                again = _white_few(broad)
                columns = again if again[0] >= WHITE else columns
        if rows[0] < WHITE and columns[0] < WHITE:
            return from_top(ids)
        areas, page = [width[i] * (y1[i] - y0[i]) for i in ids], (right - left) * (bottom - top)
        share = sum(areas) / page if page else float("inf")
        if abs(share - DENSE) < 1e-9:  # as near as that, the sum's rounding counts
            share = float(np.sum(np.array(areas))) / page
        by_row, by_column = (rows, ys), (columns, xs)
        for (gap, at), spans in (by_row, by_column) if share > DENSE else (by_column, by_row):
            if gap >= WHITE:
                first = [(a + b) / 2 < at for a, b in spans]
                if any(first) and not all(first):
                    return region([i for i, f in zip(ids, first) if f]) + region([i for i, f in zip(ids, first) if not f])
                break
        return from_top(ids)

    return region(list(range(len(x0))))


def xy_cut(sides: np.ndarray) -> list[int]:
    """The reading order of boxes (rows x0, y0, x1, y1): recursive cuts at white gaps, wide boxes put back between.

    In each region the boxes that are wide (``WIDE`` medians) and span others
    are set aside. The rest is cut at its widest white gap: across the page
    first where the region is dense, else between columns; a gap under
    ``WHITE`` is none, and columns may be told without narrow boxes. What
    can't be cut goes from the top, then from the left. Each wide box comes
    behind all that ends above it.
    """
    if len(sides) <= FEW:
        return _few(*sides.T.tolist())
    x0, y0, x1, y1 = sides.T
    width = x1 - x0
    from_top = lambda ids: ids[np.lexsort((ids, x0[ids], y0[ids]))]

    def region(ids: np.ndarray) -> np.ndarray:
        if len(ids) <= FEW:
            return ids[_few(*sides[ids].T.tolist())]
        across = np.zeros(len(ids), bool)
        if len(ids) > 2:
            for k in np.flatnonzero(width[ids] >= WIDE * np.median(width[ids])):
                i = ids[k]
                shared = np.minimum(x1[ids], x1[i]) - np.maximum(x0[ids], x0[i])
                across[k] = np.count_nonzero(shared >= SPANNED * np.minimum(width[ids], width[i])) - 1 >= SPANS
        rest, wide = ids[~across], from_top(ids[across])
        if not len(rest):
            return wide
        rest = cut(rest)
        # a box stands before the first wide one that begins below its end
        band = np.concatenate([np.searchsorted(y0[wide], y1[rest], side="left"), np.arange(len(wide))])
        after = np.concatenate([np.zeros(len(rest), int), np.ones(len(wide), int)])
        return np.concatenate([rest, wide])[np.lexsort((np.arange(len(band)), after, band))]

    def cut(ids: np.ndarray) -> np.ndarray:
        if len(ids) < 2:
            return ids
        left, top, right, bottom = x0[ids].min(), y0[ids].min(), x1[ids].max(), y1[ids].max()
        rows, columns = _white(y0[ids], y1[ids]), _white(x0[ids], x1[ids])
        broad = ids[width[ids] >= NARROW * (right - left)]
        if columns[0] < WHITE and len(ids) > 2 and 2 <= len(broad) < len(ids):
            again = _white(x0[broad], x1[broad])
            columns = again if again[0] >= WHITE else columns
        dense = (width[ids] * (y1[ids] - y0[ids])).sum() / ((right - left) * (bottom - top)) > DENSE
        for (gap, at), lo, hi in ((rows, y0, y1), (columns, x0, x1)) if dense else ((columns, x0, x1), (rows, y0, y1)):
            if gap >= WHITE:
                first = (lo[ids] + hi[ids]) / 2 < at
                if first.any() and not first.all():
                    return np.concatenate([region(ids[first]), region(ids[~first])])
                break
        return from_top(ids)

    return region(np.arange(len(sides))).tolist()


def reading_order(df: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """Adds ``position``: the reading order of a page's boxes (x0, y0, x1, y1); boxes without area or with a missing side come last.

    The cuts are decided by the page as a whole, so a page is one group.
    """
    def run(*sides: list[float]) -> list[int]:
        good = [a < c and b < d and isfinite(c - a) and isfinite(d - b) for a, b, c, d in zip(*sides)]
        ids = [i for i, g in enumerate(good) if g]
        some = [[v[i] for i in ids] for v in sides] if len(ids) < len(good) else sides
        order = _few(*some) if len(ids) <= FEW else xy_cut(np.array(some).T)
        place = [0] * len(good)
        for k, i in enumerate(order):
            place[ids[i]] = k
        for k, i in enumerate([i for i, g in enumerate(good) if not g], len(ids)):
            place[i] = k
        return place

    return per_group(df, keys, [index], ["x0", "y0", "x1", "y1"], run, "position", "float64")


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """(key, n_docs, n_lines): lines that at least ``least`` documents have, numbers aside."""
    k = lines.select("doc_id", marginal_key(F.col("line")).alias("key")).where("key <> ''")
    per = k.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines")).where(F.col("n_docs") >= least)


def repeated_margins(lines: DataFrame, doc: str = "doc_id", page: str = "page_idx", reach: int = 2) -> DataFrame:
    """Lines (text, y0, y1 in shares of the page) of the header or footer band that a near page repeats.

    Equal keys within ``reach`` pages, moved at most SHIFT and grown at most
    GROWTH. Neighbours are looked up by (document, band, key, page), so pages
    meet only pages at most ``reach`` away.
    """
    band = F.when(F.col("y0") <= HEADER, "header").when(F.col("y1") >= FOOTER, "footer")
    m = lines.withColumn("band", band).where("band is not null").withColumn("key", marginal_key(F.col("text"))).where("key <> ''")
    m = m.withColumn("h", F.col("y1") - F.col("y0"))
    other = m.select(doc, "band", "key", F.explode(F.array(*[F.col(page) + d for d in range(-reach, reach + 1) if d])).alias(page), F.col("y0").alias("oy"), F.col("h").alias("oh"))
    near = (F.abs(F.col("y0") - F.col("oy")) <= SHIFT) & (F.greatest("h", "oh") <= GROWTH * F.least("h", "oh"))
    hit = m.join(other, [doc, "band", "key", page]).where(near)
    return hit.select(doc, page, "band", "key", "text", "y0", "y1").distinct()


def continues(prev: Column, cur: Column) -> Column:
    """Whether a horizontal paragraph (text, box, first, last: per-mille boxes, n_lines, page) goes on in the next one."""
    h_first, h_last = cur["first"]["y1"] - cur["first"]["y0"], prev["last"]["y1"] - prev["last"]["y0"]
    w_cur, w_prev = cur["box"]["x1"] - cur["box"]["x0"], prev["box"]["x1"] - prev["box"]["x0"]
    open_end = ~F.trim(prev["text"]).rlike(f"[{STOP_MARKS}]$")
    goes_on = ~F.trim(cur["text"]).rlike(r"^[\d\p{Lu}]")
    return (
        open_end & goes_on & (h_first > 0) & (h_last > 0)
        & (F.abs(cur["box"]["x0"] - cur["first"]["x0"]) < h_first / 2)
        & (F.abs(prev["box"]["x1"] - prev["last"]["x1"]) < h_last)
        & (F.least(w_cur, w_prev) > 0) & (F.abs(w_cur - w_prev) < F.least(w_cur, w_prev))
        & ((cur["n_lines"] > 1) | (prev["n_lines"] > 1)) & (cur["box"]["y0"] < prev["box"]["y1"])
        & cur["page"].between(prev["page"], prev["page"] + 1)
    )


def continued_paragraphs(blocks: DataFrame, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Adds ``continues_prev`` to text blocks: an earlier text block, with no title, list or equation between, goes on in it."""
    here = F.struct("text", "box", "first", "last", "n_lines", "page")
    barrier = F.col("type").isin("doc_title", "paragraph_title", "equation", "list")
    d = last_behind_barrier(blocks, [doc], order, F.col("type") == "text", barrier, here, "__prev")
    yes = (F.col("type") == "text") & F.col("__prev").isNotNull() & continues(F.col("__prev"), here)
    return d.withColumn("continues_prev", F.coalesce(yes, F.lit(False))).drop("__prev")


def logical_blocks(blocks: DataFrame, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Blocks that continue one another as one row: (doc, first, last, text)."""
    w = Window.partitionBy(doc).orderBy(order)
    d = blocks.withColumn("__g", F.sum(F.when(F.col("continues_prev"), 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("text")))), lambda x: x["text"])
    return d.groupBy(doc, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(parts, " ").alias("text")).drop("__g")


def heading_numbers(df: DataFrame, doc: str, order: str, level: str, deepest: int = 6) -> DataFrame:
    """Adds ``number`` (1.2.1): counters of each level that a shallower heading sets back."""
    out, keys = df, [doc]
    for k in range(1, deepest + 1):
        w = Window.partitionBy(*keys).orderBy(order)
        out = out.withColumn(f"__n{k}", F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(w))
        keys = [*keys, f"__n{k}"]
    parts = F.array(*[F.when(F.col(level) >= k, F.col(f"__n{k}").cast("string")) for k in range(1, deepest + 1)])
    out = out.withColumn("number", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "."))
    return out.drop(*[f"__n{k}" for k in range(1, deepest + 1)])


def nearest_parents(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, child, parent, distance): for each child box the nearest parent box of its page; the earlier one wins a tie.

    A page's parents are gathered into one array, which each child looks
    through: the pairs of a page never become rows. A page holds few parents.
    """
    all_ = parents.groupBy(*keys).agg(F.collect_list(F.struct("parent", "parent_box")).alias("__ps"))
    nearest = F.array_min(F.transform("__ps", lambda p: F.struct(bbox.gap(F.col("child_box"), p["parent_box"]).alias("distance"), p["parent"].alias("parent"))))
    d = children.join(all_, keys).withColumn("__m", nearest)
    best = d.groupBy(*keys, "child").agg(F.min("__m").alias("m"))
    return best.select(*keys, "child", F.col("m.parent").alias("parent"), F.col("m.distance").alias("distance"))


def contained(children: DataFrame, lists: DataFrame, keys: list[str], least: float = 0.8, width: float = 100.0) -> DataFrame:
    """Each child with the first list box that covers at least ``least`` of it; boxes meet only where they overlap from top to bottom."""
    c = children.withColumn("__c0", F.col("child_box.y0")).withColumn("__c1", F.col("child_box.y1"))
    p = lists.withColumn("__p0", F.col("parent_box.y0")).withColumn("__p1", F.col("parent_box.y1"))
    pairs = interval_join(c, p, keys, ("__c0", "__c1"), ("__p0", "__p1"), width).where(bbox.overlap_of_first(F.col("child_box"), F.col("parent_box")) >= least)
    return pairs.groupBy(*keys, "child").agg(F.min("parent").alias("parent"))


def list_numbers(items: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """Adds ``number``: items of one list (and level) counted on from ``start``."""
    return items.withColumn("number", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + start - 1).cast("long"))
