"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact shingle similarity. DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import materialise, side

#: Words of a shingle.
SHINGLE = 5
#: Bits of the blocks of a 64-bit fingerprint, and the flips tried in each.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
FLIPS = 2
#: All fingerprints within this distance share a block up to FLIPS bits: 6 blocks of 3 or more make 18.
RADIUS = len(BLOCK_BITS) * (FLIPS + 1) - 1
#: Word places of a document that are looked through together for a window's shingles.
STRETCH = 64


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, of: str) -> Column:
    """The word shingles of an array column by ``of`` (a SQL function over words); under SHINGLE words the whole sequence is one."""
    parts = ", ".join(f"get({words}, __i + {k})" for k in range(SHINGLE))
    whole = f"{of}({', '.join(f'coalesce(get({words}, {k}), \"\")' for k in range(SHINGLE))})"
    return F.expr(
        f"case when size({words}) = 0 then array() when size({words}) < {SHINGLE} then array({whole}) "
        f"else transform(sequence(0, size({words}) - {SHINGLE}), __i -> {of}({parts})) end"
    )


def simhash(grams: str) -> Column:
    """The 64-bit SimHash of an array column of (h, n, weight): bits by the weighted majority of the hashes."""
    votes = f"aggregate({grams}, 0D, (__s, __x) -> __s + if(getbit(__x.h, __bit) = 1, __x.n, -__x.n) * __x.weight)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (__acc, __bit) -> __acc | shiftleft(if({votes} > 0, 1L, 0L), __bit))")


def _text_key(docs: DataFrame) -> list[Column]:
    """128 bits that name a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _flipped(block: int, value: Column, masks: list[int]) -> Column:
    flips = F.array(*[F.lit(m).cast("long") for m in masks])
    return F.transform(flips, lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value")))


def _blocks(fp: str, flips: int) -> Column:
    """(block, value) structs of a fingerprint; with flips, all values within as many bits."""
    out, at = [], 64
    for b, bits in enumerate(BLOCK_BITS):
        at -= bits
        value = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
        masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
        out.append(_flipped(b, value, masks))
    return F.flatten(F.array(*out))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(t1, t2, start, len, item_ids, similarity): windows of different texts that are at least ``threshold`` similar to an item.

    A window is as long as an item and stands where a five-word shingle of
    text and item would meet; a window that has no shingle of any item has
    similarity 0 and is not built. Of a window only the shingles that some
    item has are kept: the others can't add to its similarity, and left out
    of the fingerprint they don't move it away from an item of which the
    window holds a part. Each different window gets a SimHash of its
    shingles by weight. Six blocks of 10 or 11 bits, looked up with up to two
    bits flipped, give every item within ``RADIUS`` (17) bits. A candidate
    counts if the item's shingles that the window has, by their weight, reach
    ``threshold`` of the item's: a shingle weighs its count times
    1 + ln(items / items that have it).
    """
    items = benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    items = items.groupBy("w").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    items = materialise(items.select(F.xxhash64("w").alias("i1"), F.xxhash64(F.lit(1), "w").alias("i2"), "w", "item_ids", F.size("w").alias("len")), "items")
    n_items = items.count()
    placed = items.select("i1", "i2", "len", F.posexplode(_shingles("w", "xxhash64")).alias("off", "h"))
    starts = materialise(placed.select("h", "off", "len").distinct(), "postings")
    theirs = placed.groupBy("i1", "i2", "h").agg(F.count(F.lit(1)).alias("m"))
    weights = theirs.groupBy("h").agg((1 + F.log(F.lit(float(max(1, n_items))) / F.count(F.lit(1)))).alias("weight"))
    weights = materialise(weights, "weights")
    theirs = materialise(theirs.join(weights, "h"), "itemgrams")
    prints = theirs.groupBy("i1", "i2").agg(F.sort_array(F.collect_list(F.struct("h", F.col("m").alias("n"), "weight"))).alias("grams"), F.sum(F.col("m") * F.col("weight")).alias("total"))
    prints = materialise(prints.select("i1", "i2", "total", simhash("grams").alias("ifp")), "itemprints")
    t1, t2 = _text_key(docs)
    hashed = docs.select(t1.alias("t1"), t2.alias("t2"), words_of(F.col("text").cast("string")).alias("w")).select("t1", "t2", F.posexplode(_shingles("w", "xxhash64")).alias("pos", "h"))
    # equal texts count once from here; a row of the broadcast side is two longs
    hits = materialise(hashed.join(side(weights.select("h"), 5_000_000), "h").select("t1", "t2", "pos", "h").distinct(), "hits")
    places = hits.join(side(starts), "h").select("t1", "t2", (F.col("pos") - F.col("off")).alias("start"), "len").distinct()
    reach = [F.floor(F.greatest(F.col("start"), F.lit(0)) / STRETCH), F.floor((F.col("start") + F.greatest(F.col("len") - SHINGLE, F.lit(0))) / STRETCH)]
    spans = places.select("t1", "t2", "start", "len", F.explode(F.sequence(*[x.cast("int") for x in reach])).alias("stretch"))
    near = spans.join(hits.withColumn("stretch", F.floor(F.col("pos") / STRETCH).cast("int")), ["t1", "t2", "stretch"])
    near = near.where("pos >= start and pos <= start + greatest(len - 5, 0)")
    held = near.groupBy("t1", "t2", "start", "len", "h").agg(F.count(F.lit(1)).alias("n")).join(side(weights, 5_000_000), "h")
    held = held.groupBy("t1", "t2", "start", "len").agg(F.sort_array(F.collect_list(F.struct("h", "n", "weight"))).alias("grams"))
    windows = materialise(held.select("t1", "t2", "start", "len", F.xxhash64("grams").alias("w1"), F.xxhash64(F.lit(1), "grams").alias("w2"), "grams"), "windows")
    # each different window once, however many texts share it
    single = windows.groupBy("w1", "w2").agg(F.first("grams").alias("grams"))
    single = materialise(single.select("w1", "w2", "grams", simhash("grams").alias("fp")), "fingerprints")
    probes = prints.select("i1", "i2", "ifp", F.explode(_blocks("ifp", FLIPS)).alias("k")).select("i1", "i2", "ifp", "k.block", "k.value")
    ours = single.select("w1", "w2", "fp", F.explode(_blocks("fp", 0)).alias("k")).select("w1", "w2", "fp", "k.block", "k.value")
    pairs = ours.join(side(probes), ["block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    pairs = pairs.select("w1", "w2", "i1", "i2").distinct()
    grams = single.select("w1", "w2", F.explode("grams").alias("g")).select("w1", "w2", "g.h", "g.n")
    shared = pairs.join(grams, ["w1", "w2"]).join(theirs, ["i1", "i2", "h"])
    shared = shared.groupBy("w1", "w2", "i1", "i2").agg(F.sum(F.least("n", "m") * F.col("weight")).alias("common"))
    sure = shared.join(prints.select("i1", "i2", "total"), ["i1", "i2"]).withColumn("similarity", F.col("common") / F.col("total")).where(F.col("similarity") >= threshold - 1e-9)
    sure = materialise(sure.join(items.select("i1", "i2", "item_ids"), ["i1", "i2"]).select("w1", "w2", "item_ids", "similarity"), "matches")
    return windows.drop("grams").join(side(sure), ["w1", "w2"]).select("t1", "t2", "start", "len", "item_ids", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_ids, similarity, n_windows) for each document with a passage at least ``threshold`` similar to an item.

    See ``matches``; ``n_windows`` counts the different word sequences among
    a document's matching windows. Items without words match nothing; an item
    or a document of under five words is one shingle, so they match whole.
    Equal items are matched once and all listed. Null texts have no words;
    very long texts are looked through whole; documents without a match give
    no row, rows that repeat a doc_id one row for all their texts; rows with
    a null doc_id are told together. An empty table on either side gives no
    rows; only doc_id and text are read.
    """
    found = materialise(matches(docs, benchmark, threshold), "leaks")
    t1, t2 = _text_key(docs)
    texts = found.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "len")).alias("places"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"), F.max("similarity").alias("similarity"))
    cut = F.expr("transform(places, p -> slice(w, greatest(p.start, 0) + 1, greatest(0, least(p.start + p.len, size(w)) - greatest(p.start, 0))))")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), t1.alias("t1"), t2.alias("t2")).join(side(texts), ["t1", "t2"])
    rows = rows.withColumn("w", words_of(F.col("text"))).select("doc_id", "ids", "similarity", F.transform(cut, lambda w: F.struct(F.xxhash64(w), F.xxhash64(F.lit(1), w))).alias("windows"))
    # equal rows first: a third of all rows may be copies of one text
    rows = rows.distinct()
    return rows.groupBy("doc_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"), F.max("similarity").alias("similarity"),
        F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).cast("long").alias("n_windows"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose text has a match (see ``leaks``), whatever their doc_id."""
    gone = matches(docs, benchmark, threshold).select(F.col("t1").alias("__gone1"), F.col("t2").alias("__gone2")).distinct()
    gone = side(materialise(gone, "leaks"))
    t1, t2 = _text_key(docs)
    return docs.join(gone, (t1 == gone["__gone1"]) & (t2 == gone["__gone2"]), "left_anti")
