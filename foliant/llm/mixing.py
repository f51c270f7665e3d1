"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans.shared import buckets_for, materialise, prefix_sums, ranked, side

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level that fills ``share`` of all sizes.

    Sources in code-point order, null last, weigh ``weights`` in turn. A
    target is level x weight, at most ``cap`` x its source's size; the level
    is where the targets sum to ``share`` x all sizes, which is what sharing
    the excess again by weight comes to.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wanted = F.sum("source_size").over(every) * F.lit(float(share))
    left = wanted - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    s = s.withColumn("water", level)
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("water") * F.col("weight"), "most")).alias("target"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """(row, source, __size, __h): each row in a struct of its own, so that no name of it meets one used here."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), F.col("source").cast("string").alias("source"), size.alias("__size"))
    return rows.select("row", "source", "__size", F.xxhash64(F.lit(seed), "i", "__size").alias("__h"))


def free_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """Each name, behind "mix_" as often as it takes for none to be among ``taken`` (whatever the case)."""
    used, prefix = {x.lower() for x in taken}, ""
    while any(prefix + n in used for n in names):
        prefix += "mix_"
    return {n: prefix + n for n in names}


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, n_shards: int, rows_per_block: int, seed: int, whole: bool) -> tuple[DataFrame, int]:
    """One row for each (source, block): what is drawn from it, and for which shards; and the number of blocks."""
    base = materialise(sized.select("source", "__size", "__h"), "sizes")
    n_blocks = buckets_for(base.count(), rows_per_block, 16)
    base = base.withColumn("__block", F.pmod("__h", F.lit(n_blocks)).cast("int"))
    blocks = materialise(base.groupBy("source", "__block").agg(F.sum("__size").alias("words")), "blocks")
    sources = materialise(targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), "targets")
    quota = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(quota / F.col("source_size")), F.lit(int(cap)))).otherwise(0).cast("int")
    sources = sources.withColumn("full", full).withColumn("rest", quota - F.col("full") * F.col("source_size"))
    named = sources.select(F.col("source").alias("__s"), "source_size", "target", "full", "rest")
    # permuted blocks of each source: the first ones, up to the rest of the quota, are drawn once more
    order = F.xxhash64(F.lit(seed + 1), "source", "__block")
    ahead = prefix_sums(blocks.withColumn("__o", order), ["source"], F.col("__o"), [F.col("__o"), F.col("__block")], buckets_for(n_blocks, 4096, 1), F.col("words"), "ahead").drop("__o")
    ahead = ahead.join(side(named), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    ahead = materialise(ahead.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("ahead")))), "quotas")
    # the block in which the quota ends gives its first documents in hash order
    last = ahead.where("extra > 0 and extra < words").select(F.col("source").alias("__s"), F.col("__block").alias("__b"), "extra")
    ends = base.join(side(last), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    ends = ends.groupBy("__s", "__b", "extra", "__h").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("__s", "__b").orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0))).where("s > 0 and before < extra")
    cut_words = F.floor((F.col("extra") - F.col("before")) / F.col("n"))
    nearest = F.when(2 * (F.col("extra") - F.col("before")) >= F.col("s"), F.col("s") / F.col("n")).otherwise(0)
    cut_words = F.least(nearest if whole else cut_words, F.col("s") / F.col("n")).cast("long")
    ends = ends.groupBy("__s", "__b").agg(F.max(F.struct("__h", cut_words.alias("w"))).alias("cut"))
    ahead = ahead.join(ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left").drop("__s", "__b")
    # every draw of a block is a leaf of the splitting tree
    draws = F.sequence(F.lit(0), F.col("full") + F.when(F.col("extra") > 0, 1).otherwise(0))
    leaves = ahead.where("words > 0").select("source", "__block", F.explode(F.slice(draws, F.lit(2), F.size(draws))).alias("draw"))
    leaves = leaves.withColumn("node", F.lit(0)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(n_shards))
    n_buckets = buckets_for(n_blocks, 4096, 4)
    for depth in range(max(0, (n_shards - 1).bit_length())):
        leaves = materialise(leaves, "tree")
        counts = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("node", "__node")
        key = F.xxhash64(F.lit(seed + 2 + depth), "source", "__block", "draw")
        leaves = ranked(leaves.withColumn("__k", key), ["node"], F.col("__k"), [F.col("__k"), F.col("source"), F.col("__block"), F.col("draw")], n_buckets, "rank").drop("__k")
        leaves = leaves.join(F.broadcast(counts), F.col("node") == F.col("__node")).drop("__node")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.col("rank") < F.floor(F.col("m") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        inner = F.col("hi") - F.col("lo") > 1
        leaves = leaves.select(
            "source", "__block", "draw",
            F.when(inner, F.col("node") * 2 + F.when(left, 1).otherwise(2)).otherwise(F.col("node")).alias("node"),
            F.when(inner & ~left, mid).otherwise(F.col("lo")).alias("lo"), F.when(inner & left, mid).otherwise(F.col("hi")).alias("hi"),
        )
    shards = leaves.groupBy("source", "__block").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "lo"))), lambda x: x["lo"]).alias("shards"))
    shards = shards.select(F.col("source").alias("__s"), F.col("__block").alias("__b"), "shards")
    out = ahead.join(shards, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    return materialise(out.select(F.col("source").alias("__source"), F.col("__block").alias("__blk"), "source_size", "target", "full", "words", "extra", "cut", "shards"), "draws"), n_blocks


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, n_shards: int, rows_per_block: int, seed: int, whole: bool) -> DataFrame:
    """(row, size, source_size, target, taken, draws) of every row."""
    sized = _sized(docs, seed)
    quotas, n_blocks = plan(sized, weights, share, cap, n_shards, rows_per_block, seed, whole)
    rows = sized.withColumn("__block", F.pmod("__h", F.lit(n_blocks)).cast("int"))
    rows = rows.join(side(quotas, 50_000), F.col("source").eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__blk")))
    more = F.when(F.col("extra") == F.col("words"), F.col("__size"))
    more = more.when((F.col("extra") > 0) & (F.col("__h") < F.col("cut.__h")), F.col("__size"))
    more = more.when((F.col("extra") > 0) & (F.col("__h") == F.col("cut.__h")), F.col("cut.w")).otherwise(F.lit(0))
    rows = rows.withColumn("__more", more.cast("long"))
    drawn = F.transform("shards", lambda s, i: F.struct(s.alias("shard"), F.when(i < F.col("full"), F.col("__size")).otherwise(F.col("__more")).alias("words"), F.xxhash64(F.lit(seed + 99), i, "__h").alias("key")))
    drawn = F.filter(F.coalesce(drawn, F.array()), lambda d: d["words"] > 0)
    return rows.select("row", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("full") + F.col("__more")).alias("taken"), drawn.alias("draws"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, n_shards: int = 8, rows_per_block: int = 4096, seed: int = 17, whole: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, taken and draws (an array of shard, words, key).

    A source's target (see ``targets``) is drawn as whole passes over its
    blocks plus a part pass over a prefix of its permuted blocks; the block
    where the quota ends gives documents in hash order, the last of them in
    part (``whole``: whole documents, the nearest number). Blocks are hash
    buckets of about ``rows_per_block`` documents, so a hot source has many.
    The draws of all sources then go down a binary tree to ``n_shards``
    leaves: each node sends a uniformly random half of its draws left, so the
    sources' counts are multivariate hypergeometric and each shard gets an
    equal number. ``key`` orders a draw inside its shard: shards are shuffled
    locally by it. Everything follows from ``seed`` and the rows: reruns agree.

    Null texts and texts without words have size 0 and no draws; very long
    texts are counted whole. A null source is a source. Rows that repeat a
    doc_id and a size share one fate. An empty table gives no rows. All
    columns of ``docs`` stay as they are; if one has the name of an added
    one, all added ones stand behind "mix_" (see ``free_names``).
    """
    out = _drawn(docs, weights, share, cap, n_shards, rows_per_block, seed, whole)
    names = free_names(["size", "source_size", "target", "taken", "draws"], docs.columns)
    return out.select("row.*", *[F.col(c).alias(n) for c, n in names.items()])


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, n_shards: int = 8, rows_per_block: int = 4096, seed: int = 17) -> DataFrame:
    """One row of ``docs`` for each draw of a whole document, with its shard and key (names as in ``mix``)."""
    out = _drawn(docs, weights, share, cap, n_shards, rows_per_block, seed, True).select("row", F.explode("draws").alias("d"))
    names = free_names(["shard", "key"], docs.columns)
    return out.select("row.*", *[F.col(f"d.{c}").alias(n) for c, n in names.items()])


def laid_out(docs: DataFrame, n_shards: int = 8, **how) -> DataFrame:
    """``mixed_rows`` as they are to be written: each shard in partitions of its own, shuffled by the keys; only ``docs``'s columns.

    A shard is dealt over as many partitions as the session's shuffle has for each.
    """
    names = free_names(["shard", "key"], docs.columns)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed_rows(docs, n_shards=n_shards, **how)
    shard, key = F.col(names["shard"]), F.col(names["key"])
    dealt = rows.repartition(max(parts, n_shards), shard, F.pmod(key, F.lit(max(1, parts // n_shards))))
    return dealt.sortWithinPartitions(shard, key).select(*[F.col(f"`{c}`") for c in docs.columns])
