"""SimHash fingerprints and their near pairs by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.components import connected_components
from foliant.plans.shared import materialise, side, trim, whole_groups

BITS = 64


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text's word shingles, as an unsigned integer.

    A-Z are lower-cased, words are runs without ASCII white space, repeats
    count. Under ``words`` words the whole sequence is one shingle; a text
    without words (or null) has fingerprint 0. A bit is 1 if it is set in
    more than half of the hashes.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_digest
    got = b"".join([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())])
    n = len(got) // 8
    bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(n, 8), axis=1)
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def text_key() -> list[Column]:
    """128 bits that name a row's text (t1, t2)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, t1, t2, fp): the name of every row's text and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], ["doc_id", "t1", "t2", "fp"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, t1 long, t2 long, fp long")


class _Union:
    """Labels of rows, joined by the least; ``until`` is where a run of equal labels ends."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.runs()

    def runs(self) -> None:
        n = len(self.of)
        cut = np.flatnonzero(np.diff(self.of)) + 1
        ends = np.append(cut, n)
        self.until = ends[np.searchsorted(cut, np.arange(n), side="right")]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            rest = a != b
            if not rest.any():
                break
            i, j, a, b = i[rest], j[rest], a[rest], b[rest]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up
        self.runs()


def trie_links(rest: np.ndarray, roots: list[tuple[np.ndarray, ...]], depth: int, budget: int, most: int = 1 << 20) -> np.ndarray:
    """The component label of each row after joining a trie with itself.

    ``rest`` holds sorted keys within each root's ranges; only the low
    ``depth`` bits differ below a root. ``roots`` has (a_lo, a_hi, b_lo,
    b_hi, errors) arrays; equal ranges mean a node with itself. Node pairs
    are split together bit by bit, differing bits add up, and a pair goes as
    soon as they exceed ``budget``. A pair whose rows all share one label
    already can add no connection and goes as well. At most about ``most``
    node pairs are held at once: the others wait on a stack.
    """
    n = len(rest)
    joined = _Union(n)
    zeros = np.uint64(0)
    ones: dict[int, np.ndarray] = {}

    def below(level: int) -> np.ndarray:
        if level not in ones:
            bit = (rest >> np.uint64(level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit != zeros)]).astype(np.int64)
        return ones[level]

    stack = [(depth, *[np.asarray(x, np.int64) for x in roots])]
    while stack:
        level, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > most:
            half = len(alo) // 2
            stack += [(level, *[x[:half] for x in (alo, ahi, blo, bhi, err)]), (level, *[x[half:] for x in (alo, ahi, blo, bhi, err)])]
            continue
        same = alo == blo
        keep = ~(same & (ahi - alo < 2))
        one = (joined.until[alo] >= ahi) & (joined.until[blo] >= bhi) & (joined.of[alo] == joined.of[blo])
        keep &= ~one
        single = keep & ~same & (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            mask = np.uint64((1 << level) - 1)
            near = np.bitwise_count((rest[i] ^ rest[j]) & mask).astype(np.int64) + err[single] <= budget
            joined.link(i[near], j[near])
        keep &= ~single
        if not keep.any():
            continue
        alo, ahi, blo, bhi, err, same = (x[keep] for x in (alo, ahi, blo, bhi, err, same))
        if not level:
            joined.link(alo, blo)
            continue
        count = below(level - 1)
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        cross = ~same
        a0, a1, b0, b1 = (alo, amid), (amid, ahi), (blo, bmid), (bmid, bhi)
        parts = [(a0, b0, 0, None), (a1, b1, 0, None), (a0, b1, 1, None), (a1, b0, 1, cross)]
        out = []
        for (l1, h1), (l2, h2), more, only in parts:
            ok = (h1 > l1) & (h2 > l2) & (err + more <= budget)
            if only is not None:
                ok &= only
            out.append((l1[ok], h1[ok], l2[ok], h2[ok], err[ok] + more))
        stack.append((level - 1, *[np.concatenate(x) for x in zip(*out)]))
    return joined.of


#: Rows of whole groups that a worker looks at together, and the most bits that split a crowded group.
HELD, MOST_SPLIT = 200_000, 16


def tables(budget: int, n: int, crowded: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """(key segments, other segments) of a fingerprint for each table; a segment is (lowest bit, bits).

    With ``budget`` + k blocks any near pair has k equal ones, so each choice
    of k blocks is a table keyed by their bits. k is the least (up to 3) for
    which a key has well under ``crowded`` of ``n`` spread fingerprints:
    with three errors 4 tables of 16 bits, 10 of 25, or 20 of 31.
    """
    for k in (1, 2, 3):
        m = budget + k
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        if n >> sum(sorted(widths)[:k]) <= crowded // 8 or k == 3:
            break
    starts = [BITS - sum(widths[: i + 1]) for i in range(m)]
    segments = list(zip(starts, widths))
    return [([segments[i] for i in c], [segments[i] for i in range(m) if i not in c]) for c in combinations(range(m), k)]


def _gathered(segments: list[tuple[int, int]]) -> Column:
    """The bits of fp's segments end to end."""
    out = F.lit(0).cast("long")
    for start, n in segments:
        out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << n) - 1)))
    return out


KEYS = ["table", "value", "low", "high"]


def _join_partition(budget: int):
    """Links within the groups (``KEYS``) of one sorted partition, as a forest of (src, dst) fingerprints."""

    def linked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table, value, low, high, own, depth, rest, fp = (t.column(c).to_numpy() for c in (*KEYS, "own", "depth", "rest", "fp"))
        rest = np.ascontiguousarray(rest).view(np.uint64)
        new = np.concatenate([[True], (np.diff(table) != 0) | (np.diff(value) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(fp))
        whole = low[lo] == high[lo]
        at_high = np.concatenate([[0], np.cumsum(own == high)])
        mid = np.where(whole, hi, hi - (at_high[hi] - at_high[lo]))
        errors = np.where(whole, 0, np.bitwise_count((low[lo] ^ high[lo]).astype(np.uint64)).astype(np.int64))
        full = (mid > lo) & (whole | (hi > mid))
        of = np.arange(len(fp))
        for d in np.unique(depth[lo]).tolist():
            pick = full & (depth[lo] == d)
            if pick.any():
                roots = (lo[pick], np.where(whole, hi, mid)[pick], np.where(whole, lo, mid)[pick], hi[pick], errors[pick])
                part = trie_links(rest, roots, d, budget)
                of = np.where(part != np.arange(len(fp)), part, of)
        moved = np.flatnonzero(of != np.arange(len(fp)))
        return fp[moved], fp[of[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, KEYS, HELD):
            src, dst = linked(t)
            for s in range(0, len(src), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(src[s : s + 65536]), pa.array(dst[s : s + 65536])], ["src", "dst"])
        trim()

    return run


def near_links(fps: DataFrame, budget: int = 3, crowded: int = 50_000, least_k: int = 1) -> DataFrame:
    """(src, dst) links that connect all distinct fingerprints within ``budget`` differing bits.

    Each key of each of the ``tables`` is a subtree of the trie over the
    bits turned to start with that key, and the join below it is local. A key
    that more than ``crowded`` fingerprints share is split: its pairs of
    child nodes within the budget become groups of their own, each with the
    errors so far; the more fingerprints, the deeper the children (up to
    ``MOST_SPLIT`` bits). Links inside a group are given as a spanning
    forest: no connection is lost and no group is expanded into all its
    pairs. A worker holds whole groups of a sorted partition, about ``HELD``
    rows at once. ``least_k`` asks for tables of at least so many blocks.
    """
    n = max(fps.count(), (crowded // 8 + 1) << {1: 0, 2: 16, 3: 26}[least_k])
    sets = tables(budget, n, crowded)
    struct = [F.struct(F.lit(t).alias("table"), _gathered(key).alias("value"), _gathered(rest).alias("rest"), F.lit(sum(w for _, w in rest)).alias("depth")) for t, (key, rest) in enumerate(sets)]
    keyed = fps.select("fp", F.explode(F.array(*struct)).alias("k")).select("fp", "k.table", "k.value", "k.rest", "k.depth")
    counts = keyed.groupBy("table", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)
    counts = materialise(counts.select("table", "value", F.least(F.lit(MOST_SPLIT), F.ceil(F.log2(F.col("n") / crowded)) + 1).cast("int").alias("split")), "crowded")
    if counts.limit(1).count():
        keyed = keyed.join(counts, ["table", "value"], "left").withColumn("split", F.coalesce("split", F.lit(0)))
        # no bits: the one child 0, alone with itself
        keyed = keyed.withColumn("own", F.when(F.col("split") > 0, F.expr("shiftrightunsigned(rest, depth - split)")).otherwise(0).cast("int"))
        flips = F.array(*[F.lit(x) for x in range(1 << MOST_SPLIT) if x.bit_count() <= budget])
        keyed = keyed.withColumn("x", F.explode(F.filter(flips, lambda x: x < F.expr("shiftleft(1, split)"))))
        keyed = keyed.withColumn("o", F.col("own").bitwiseXOR(F.col("x"))).withColumn("depth", F.col("depth") - F.col("split"))
        keyed = keyed.select("table", "value", F.least("own", "o").alias("low"), F.greatest("own", "o").alias("high"), "own", "depth", "rest", "fp")
    else:
        zero = F.lit(0)
        keyed = keyed.select("table", "value", zero.alias("low"), zero.alias("high"), zero.alias("own"), "depth", "rest", "fp")
    return keyed.repartition(*KEYS).sortWithinPartitions(*KEYS, "rest").mapInArrow(_join_partition(budget), "src long, dst long")


def near_components(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42, crowded: int = 50_000) -> DataFrame:
    """(doc_id, t1, t2, fp, component_id, root) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links of at most ``budget``
    differing bits reach; ``root`` names the component by one of its
    fingerprints. Equal fingerprints are one node, so copies are not paired.
    Null and wordless texts share fingerprint 0; very long texts are
    fingerprinted whole; a tie of a bit's votes is 0; rows with a null doc_id
    take part, and their component_id is null only if all its ids are;
    repeated rows stay; other columns of ``docs`` are ignored; no rows give
    no rows.
    """
    prints = materialise(fingerprints(docs, words, seed), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = materialise(connected_components(near_links(nodes.select("fp"), budget, crowded)), "fpcomp")
    placed = nodes.join(comp, nodes.fp == comp.node, "left").select(nodes.fp.alias("fp"), "least", F.coalesce("component", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(firsts, "root").select(F.col("fp").alias("__fp"), "component_id", "root")
    return prints.join(labels, prints.fp == F.col("__fp")).select("doc_id", "t1", "t2", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each near-copy component; see ``one_of_each``."""
    return one_of_each(docs, near_components(docs, words, budget, seed))


def one_of_each(docs: DataFrame, comp: DataFrame) -> DataFrame:
    """``docs`` with one row of each component in ``comp`` (doc_id, t1, t2, root).

    A row is known by its doc_id and text. The one of the smallest doc_id
    (nulls last), and of several texts of it the least by hash, stays; of
    rows that repeat both, the least by its columns as JSON.
    """
    ids = materialise(comp.groupBy("root", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")), "decisions")
    name = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2")
    kept = ids.groupBy(F.col("root").alias("__root")).agg(F.min(name).alias("kept"))
    marked = ids.join(kept, F.col("root") == F.col("__root")).withColumn("stays", (F.col("kept") == name))
    marked = materialise(marked.select("doc_id", "t1", "t2", "n", "stays"), "marked")

    def named(rows: DataFrame) -> DataFrame:
        return side(rows.select(F.col("doc_id").alias("__i"), F.col("t1").alias("__1"), F.col("t2").alias("__2")))

    def same(other: DataFrame) -> Column:
        t1, t2 = text_key()
        return docs["doc_id"].cast("long").eqNullSafe(other["__i"]) & (t1 == other["__1"]) & (t2 == other["__2"])

    gone = named(marked.where(~F.col("stays")))
    twice = marked.where("stays and n > 1")
    left = docs.join(gone, same(gone), "left_anti")
    if not twice.limit(1).count():
        return left
    again = named(twice)
    once = left.join(again, same(again), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = left.join(again, same(again)).groupBy("__i", "__1", "__2").agg(F.min_by(row, F.to_json(row)).alias("__r"))
    return once.unionByName(least.select("__r.*"))
