"""Shards of indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import buckets_for, materialise, ranked


class CapacityTree:
    """Open bins ordered by (remaining capacity, bin) in an AA tree."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # a node is [key, level, left, right]

    @staticmethod
    def _skew(n):
        if n[2] and n[2][1] == n[1]:
            left = n[2]
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        if n[3] and n[3][3] and n[3][3][1] == n[1]:
            right = n[3]
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def add(self, key):
        self.root = self._add(self.root, key)

    def _add(self, n, key):
        if n is None:
            return [key, 1, None, None]
        side = 2 if key < n[0] else 3
        n[side] = self._add(n[side], key)
        return self._split(self._skew(n))

    def remove(self, key):
        self.root = self._remove(self.root, key)

    def _remove(self, n, key):
        if n is None:
            return None
        if key != n[0]:
            side = 2 if key < n[0] else 3
            n[side] = self._remove(n[side], key)
        elif n[2] is None and n[3] is None:
            return None
        else:
            side, other = (3, 2) if n[2] is None else (2, 3)
            near = n[side]
            while near[other]:
                near = near[other]
            n[0] = near[0]
            n[side] = self._remove(n[side], near[0])
        level = min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0) + 1
        if level < n[1]:
            n[1] = level
            if n[3] and n[3][1] > level:
                n[3][1] = level
        n = self._skew(n)
        if n[3]:
            n[3] = self._skew(n[3])
            if n[3][3]:
                n[3][3] = self._skew(n[3][3])
        n = self._split(n)
        if n[3]:
            n[3] = self._split(n[3])
        return n

    def tightest(self, size):
        """The least key with at least ``size`` remaining, or None."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                best, n = n[0], n[2]
            else:
                n = n[3]
        return best


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (class, bin, items) for ``classes`` of (size, items), largest size first: each item goes into the fullest open bin that it fits, else a new one.

    An item over ``capacity`` gets a bin of its own. A bin that takes an item
    stays the tightest for the next one of that size as long as it fits, so
    the items of a class that share a bin are placed at once: the work is
    that of the classes and bins, not of the items. None if more than
    ``most`` bins are needed.
    """
    tree, bins, out = CapacityTree(), 0, []
    for k, (size, items) in enumerate(classes):
        while items:
            at = tree.tightest(size)
            if at is None:
                if bins == most:
                    return None
                at, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(at)
            n = min(items, at[0] // size)
            tree.add((at[0] - n * size, at[1]))
            out.append((k, at[1], n))
            items -= n
    return out


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs (class, bin, items), bins 0 to ``bins`` - 1, loads as equal as best fit makes them; ``classes`` as above.

    An item at least as large as the mean of what is left has a bin of its
    own. The others go in at the least capacity (to a 100,000th of a bin) for
    which best-fit-decreasing needs no more bins than are left.
    """
    own, left, total, rest, out = 0, bins, sum(s * n for s, n in classes), [], []
    for k, (size, n) in enumerate(classes):
        alone = 0
        while left > 1 and alone < n and not rest and size * left >= total:
            total, own, left, alone = total - size, own + 1, left - 1, alone + 1
            out.append((k, own - 1, 1))
        if alone < n:
            rest.append((k, size, n - alone))
    if not rest:
        return out
    items = [(s, n) for _, s, n in rest]
    low, step = max(-(-total // left), items[0][0]), max(1, total // (left * 100_000))
    fits, reach = best_fit_decreasing(items, low, left), 0
    while fits is None:
        reach = max(1, 2 * reach)
        fits = best_fit_decreasing(items, low + reach * step, left)
    bad = reach // 2 if reach > 1 else 0
    while reach - bad > 1:
        mid = (reach + bad) // 2
        got = best_fit_decreasing(items, low + mid * step, left)
        fits, reach, bad = (got, mid, bad) if got else (fits, reach, mid)
    return out + [(rest[k][0], own + b, n) for k, b, n in fits]


def shard(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2, shard, slot): equal texts stay together and shards have near equal bytes.

    Size is UTF-8 bytes plus 1; groups are equal texts (null counts as
    empty), known by 128 bits of hash. Every group is packed by
    best-fit-decreasing: the driver sees the different sizes of groups with
    their counts - fewer than the square root of twice all bytes, whatever
    the number of groups - and groups of one size are interchangeable, so
    they take their size's places in hash order. A group that holds many rows
    is joined by broadcast (fewer than four for each shuffle partition are
    that large). ``slot`` numbers a shard's rows from 0 in hash order without
    one task for each shard. Very long texts are only measured and hashed.
    Repeated rows each get a slot; no rows give no rows; columns other than
    doc_id and text are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
    )
    base = materialise(base, "shardrows")
    groups = materialise(base.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("rows")).toArrow().to_pydict()
    rows, found = sum(sizes["rows"]), sum(sizes["items"])
    classes = sorted(zip(sizes["bytes"], sizes["items"]), reverse=True)
    runs: list[list[dict]] = [[] for _ in classes]
    for k, b, n in pack(classes, n_shards):
        runs[k].append({"upto": (runs[k][-1]["upto"] if runs[k] else 0) + n, "shard": b})
    kind = pa.schema([("__bytes", pa.int64()), ("runs", pa.list_(pa.struct([("upto", pa.int64()), ("shard", pa.int32())])))])
    places = spark.createDataFrame(pa.table([[s for s, _ in classes], runs], schema=kind))
    order = [F.col("k1"), F.col("k2")]
    named = ranked(groups, ["bytes"], F.col("k1"), order, buckets_for(found, 8192, 1), "rank")
    named = named.join(F.broadcast(places) if len(classes) <= 200_000 else places, F.col("bytes") == F.col("__bytes"))
    named = materialise(named.select("k1", "k2", "n", F.expr("filter(runs, r -> r.upto > rank)[0].shard").alias("shard")), "places")
    hot = F.col("n") > max(1000, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    heavy = F.broadcast(named.where(hot).drop("n"))
    out = ["doc_id", "size", "text_crc32", "k1", "k2", "shard"]
    placed = base.join(heavy, ["k1", "k2"]).select(*out)
    placed = placed.union(base.join(heavy.drop("shard"), ["k1", "k2"], "left_anti").join(named.where(~hot).drop("n"), ["k1", "k2"]).select(*out))
    h = F.xxhash64("doc_id", "k1")
    return ranked(placed, ["shard"], h, [h, F.col("doc_id"), F.col("k1"), F.col("k2")], buckets_for(rows, 8192, 16), "slot")
