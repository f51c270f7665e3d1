"""Near copies for the pipeline: the SimHash trie join, verified by exact Jaccard similarity, completed over rare shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.trie_join import near_links, one_of_each, text_key
from foliant.operators.components import connected_components
from foliant.plans.shared import give_back, materialise, side, trim, whole_groups

#: Words of a shingle, and the similarity from which two texts are near copies.
SHINGLE = 5
THRESHOLD = 0.8
#: One document in so many is looked at for common shingles; the most of them that are told to workers.
SAMPLE, COMMON = 16, 200_000
#: Up to so many texts with one shingle are paired at once; more are first linked to a hub and to neighbours.
FEW = 32
#: Bits of a set's parity sketch, as a power of two.
SKETCH = 11


def shingles(text: bytes | None, words: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Sorted hashes of a UTF-8 text's different word shingles.

    A-Z are lower-cased, words are runs without ASCII white space. Under
    ``words`` words the whole sequence is one shingle; a text without words
    (or null) has none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(parts) - words + 1
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, n))


def set_key(hashes: np.ndarray) -> int:
    """One signed long for a set of shingles: equal sets are one node."""
    key = xxhash.xxh64_intdigest(hashes.tobytes())
    return key - (1 << 64) if key >> 63 else key


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The shingles of which a set at least ``threshold`` similar has one in its own prefix.

    Shingles are ordered by (count, hash), rare ones first; of n, all but the
    last ceil(threshold * n) - 1 are taken. Any one order of all shingles
    guarantees this, so counts may be rough.
    """
    n = len(hashes)
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))][: n - math.ceil(threshold * n - 1e-9) + 1]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes by their upper bits: two sketches differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((hashes >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.uint8) & 1).view(np.int64)


def simhash_of(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of a set of shingles; 0 for none."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    got = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes()
    return int.from_bytes(got, "big", signed=True)


def _each(docs: DataFrame, columns: str, rows) -> DataFrame:
    """``rows(texts)`` gives Arrow arrays for a batch's texts, named by ``columns`` behind doc_id, t1 and t2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t1", "t2", *[c.split()[0] for c in columns.split(", ")]]
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for s in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(s, 256) for k in range(3)], *rows([t.as_py() for t in texts.slice(s, 256)])], names)
        trim()

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("string").alias("text"))
    return some.mapInArrow(run, f"doc_id long, t1 long, t2 long, {columns}")


def _signed(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))


def _sets(texts: list[bytes | None]) -> list[pa.Array]:
    got = [shingles(t) for t in texts]
    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
    return [pa.array([set_key(h) for h in got], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), _signed(got))]


def _prefixes(common: np.ndarray, counts: np.ndarray):
    def rows(texts: list[bytes | None]) -> list[pa.Array]:
        got = [shingles(t) for t in texts]
        heads = [prefix(h, common, counts) if len(h) else h for h in got]
        ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
        sketches = pa.array(np.concatenate([np.empty(0, np.int64), *map(sketch, got)]))
        places = pa.array(np.arange(len(got) + 1, dtype=np.int32) * (1 << SKETCH - 6))
        return [
            pa.array([set_key(h) for h in got], pa.int64()), pa.array([simhash_of(h) for h in got], pa.int64()), pa.array([len(h) for h in got], pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), _signed(heads)), pa.ListArray.from_arrays(places, sketches),
        ]

    return rows


#: Postings of whole shingles that a worker looks at together.
HELD = 200_000


def _bucket_pairs(threshold: float, few: int, later: bool):
    """Pairs of sets that share a shingle, have different labels, and can reach ``threshold`` by their sizes and the shingle's places.

    Rows are (h, key, n, pos, label), sorted by h. Of a shingle that more
    than ``few`` sets have, only each set's pairs with the first one and with
    the next are given, and its rows are given back; ``later``, all pairs.
    """

    def batch(h=None, a=None, b=None, n=None, pos=None) -> pa.RecordBatch:
        size = len(a)
        none = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
        return pa.RecordBatch.from_arrays([none(h, pa.int64()), none(a, pa.int64()), none(b, pa.int64()), none(n, pa.int32()), none(pos, pa.int32())], ["h", "a", "b", "n", "pos"])

    def some(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h, key, n, pos, label = (table.column(c).to_numpy() for c in ("h", "key", "n", "pos", "label"))
        order = np.lexsort((key, n, h))
        h, key, n, pos, label = (x[order] for x in (h, key, n, pos, label))
        lo = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
        size = np.diff(np.append(lo, len(h)))
        first, many = np.repeat(lo, size), np.repeat(size, size)
        end = first + many

        def pairs(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])  # the shingle, if it is the pair's first, and what follows
            ok = (label[i] != label[j]) & (n[i] >= threshold * n[j] - 1e-9) & (most >= threshold / (1 + threshold) * (n[i] + n[j]) - 1e-9)
            a, b = key[i[ok]], key[j[ok]]
            got = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            for s in range(0, got.shape[1], 65536):
                yield batch(a=got[0, s : s + 65536], b=got[1, s : s + 65536])

        left = np.flatnonzero(many > 1)
        full = left if later else left[many[left] <= few]
        d = 1
        while len(full):
            full = full[full + d < end[full]]
            if len(full):
                yield from pairs(full, full + d)
            d += 1
        large = np.empty(0, np.int64) if later else left[many[left] > few]
        if len(large):
            rest = large[large > first[large]]
            yield from pairs(first[rest], rest)
            yield from pairs(rest - 1, rest)
            for s in range(0, len(large), 65536):
                x = large[s : s + 65536]
                yield batch(h=h[x], a=key[x], n=n[x], pos=pos[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], HELD):
            yield from some(table)
        trim()

    return run


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of documents have, sorted, and how many: they only order the prefixes."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    seen = _each(some, "key long, h array<long>", _sets).select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def similar_components(docs: DataFrame, threshold: float = THRESHOLD, few: int = FEW, budget: int = 3) -> DataFrame:
    """(doc_id, t1, t2, root) for every row: ``root`` is what pairs of texts with Jaccard similarity of at least ``threshold`` connect.

    Similarity is that of the sets of five-word shingles (``shingles``).
    First the trie join links SimHash fingerprints of the sets within
    ``budget`` bits, and each link is verified on the whole sets. Few pairs
    near the threshold are that close, so the rest follows: every similar
    pair shares a shingle of its prefixes, and each pair of sets still apart
    that does and can be similar by its sizes and parity sketches is verified
    on the whole sets; no pair is missed and none stands unverified. Where a
    shingle is in many prefixes, a first round verifies a star and a chain,
    and only sets that these leave apart are paired in a second one. Equal
    sets are one node. Null and wordless texts are one group; very long texts
    are compared whole; ties can't arise, since no pair is preferred; rows
    with a null doc_id take part; repeated rows stay; no rows give no rows.
    """
    spark = docs.sparkSession

    def settled(df: DataFrame, label: str) -> DataFrame:
        """``materialise``; then the driver gives back what that step's plan and broadcasts took."""
        got = materialise(df, label)
        give_back(spark)
        return got

    common, counts = _common(docs)
    prints = settled(_each(docs, "key long, fp long, n int, h array<long>, s array<long>", _prefixes(common, counts)), "prefixes")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2")).alias("row")
    nodes = settled(prints.groupBy("key").agg(row, *[F.first(c).alias(c) for c in ("fp", "n", "h", "s")]), "nodes")

    def verified(pairs: DataFrame) -> DataFrame:
        sides = [nodes.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab"]
        apart = F.expr("aggregate(zip_with(sa, sb, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
        near = pairs.join(sides[0], "a").join(sides[1], "b").where(apart <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-9)
        near = settled(near.select("a", "b"), "candidates")
        keys = near.select(F.col("a").alias("key")).union(near.select(F.col("b").alias("key"))).distinct()
        rows = nodes.join(keys, "key", "left_semi").select(F.col("row.doc_id").alias("__i"), F.col("row.t1").alias("__1"), F.col("row.t2").alias("__2"))
        rows = side(settled(rows, "held"))
        t1, t2 = text_key()
        held = docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["__i"]) & (t1 == rows["__1"]) & (t2 == rows["__2"]), "left_semi")
        sets = settled(_each(held.select("doc_id", "text"), "key long, h array<long>", _sets).select("key", "h"), "sets")
        once = sets.agg(F.count("key").alias("n"), F.count_distinct("key").alias("m")).first()
        if once.n != once.m:  # rows that repeat
            sets = sets.groupBy("key").agg(F.first("h").alias("h"))
        sides = [sets.select(F.col("key").alias(c), F.col("h").alias(f"h{c}")) for c in "ab"]
        both = near.join(sides[0], "a").join(sides[1], "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
        sure = F.col("common") / (F.size("ha") + F.size("hb") - F.col("common")) >= threshold
        return settled(both.where(sure).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")

    named = settled(nodes.groupBy("fp").agg(F.min("key").alias("first")), "named")
    close = settled(near_links(named.select("fp"), budget), "close")
    ends = [named.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_key")) for c in ("src", "dst")]
    tried = close.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    equal = nodes.select("key", "fp").join(named, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    links = verified(tried.union(equal))

    def labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
        return rows.join(comp, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("component", "key")).drop("node", "component")

    # for the first round the least neighbour will do: sets that share one are connected
    ends = links.select("src", "dst").union(links.select("dst", "src")).toDF("node", "other")
    near = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component"))

    schema = "h long, a long, b long, n int, pos int"
    posted = labelled(nodes.select("key", "n", "h"), near).select("key", "n", "label", F.posexplode("h").alias("pos", "h")).select("h", "key", "n", "pos", "label")
    first = settled(posted.repartition("h").sortWithinPartitions("h").mapInArrow(_bucket_pairs(threshold, few, False), schema), "pairs")
    tried = settled(first.where("b is not null").select("a", "b").distinct(), "tried")
    links = links.union(verified(tried))
    large = first.where("h is not null")
    if large.limit(1).count():
        comp = settled(connected_components(links, between=lambda: give_back(spark)), "setcomp")
        posted = labelled(large.withColumnRenamed("a", "key"), comp).select("h", "key", "n", "pos", "label")
        rest = posted.repartition("h").sortWithinPartitions("h").mapInArrow(_bucket_pairs(threshold, few, True), schema).select("a", "b").distinct()
        links = links.union(verified(settled(rest.join(tried, ["a", "b"], "left_anti"), "rest")))
    comp = settled(connected_components(links, between=lambda: give_back(spark)), "setcomp")
    roots = labelled(nodes.select("key"), comp).select(F.col("key").alias("__key"), F.col("label").alias("root"))
    return prints.join(roots, prints.key == F.col("__key")).select("doc_id", "t1", "t2", "root")


def similar_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of similar texts, the one of the smallest doc_id; see ``one_of_each``."""
    return one_of_each(docs, similar_components(docs, threshold))
