"""Captions and footnotes with the pictures and tables they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import bbox
from foliant.plans.shared import dealt

# Which block types may have captions and footnotes.
MAIN = ("image", "table", "chart", "code")


def caption_parents(blocks: DataFrame, keys: list[str], placed: bool = False) -> DataFrame:
    """(keys, child, parent): each caption's or footnote's block among the MAIN blocks, at any distance.

    Only captions may stand between a caption and its block, and captions or
    footnotes between a footnote and its; a footnote never comes first. Of
    the legal ones the nearest in order wins; on a tie the smaller gap, then,
    for a table's caption the later block, for others the earlier. The rows
    of a task are bounded (``dealt``); ``placed``: the blocks already lie so.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    b = blocks.select(*keys, "idx", "type", "b")
    b = (b if placed else dealt(b, keys)).withColumn("pos", F.row_number().over(order))
    other = F.when(~F.col("type").isin("caption", "footnote"), 1).otherwise(0)
    b = b.withColumn("solid", F.sum(other).over(order)).withColumn("noncaption", F.sum(F.when(F.col("type") == "caption", 0).otherwise(1)).over(order))
    # no MAIN block may stand between, so only the last one before and the first one after can be legal
    main = F.when(F.col("type").isin(*MAIN), F.struct("pos", F.col("idx").alias("parent"), F.col("type").alias("pt"), F.col("b").alias("pb"), "solid", "noncaption"))
    ends = [F.last(main, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("pos"), F.desc("pos"))]
    b = b.withColumn("ends", F.array(*ends)).where(F.col("type").isin("caption", "footnote"))
    child = b.select(*keys, F.col("idx").alias("child"), F.col("pos").alias("cp"), F.col("type").alias("ct"), F.col("b").alias("cb"), F.col("solid").alias("cs"), F.col("noncaption").alias("cn"), F.explode("ends").alias("m"))
    j = child.where(F.col("m").isNotNull()).select("*", "m.*")
    # blocks strictly between, other than the allowed ones
    before = F.col("pos") < F.col("cp")
    solid = F.when(before, F.col("cs") - F.col("solid")).otherwise(F.col("solid") - 1 - F.col("cs"))
    noncaption = F.when(before, F.col("cn") - F.col("noncaption")).otherwise(F.col("noncaption") - 1 - F.col("cn"))
    legal = F.when(F.col("ct") == "caption", noncaption == 0).otherwise((solid == 0) & before)
    near = F.abs(F.col("pos") - F.col("cp"))
    side = F.when((F.col("ct") == "caption") & (F.col("pt") == "table"), -F.col("pos")).otherwise(F.col("pos"))
    best = j.where(legal).groupBy(*keys, "child").agg(F.min_by("parent", F.struct(near, F.round(bbox.gap(F.col("cb"), F.col("pb")), 3), side)).alias("parent"))
    return best


def regrouped(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, type, captions, footnotes) of every MAIN block, and the captions that have none as text."""
    pairs = caption_parents(blocks, keys).withColumnRenamed("child", "idx")
    kids = blocks.join(pairs, [*keys, "idx"]).groupBy(*keys, "parent").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "caption", F.struct("idx", "text")))), lambda x: x["text"]).alias("captions"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "footnote", F.struct("idx", "text")))), lambda x: x["text"]).alias("footnotes"),
    ).withColumnRenamed("parent", "idx")
    rest = blocks.join(pairs.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    none = F.array().cast("array<string>")
    out = rest.join(kids, [*keys, "idx"], "left")
    return out.withColumn("captions", F.coalesce("captions", none)).withColumn("footnotes", F.coalesce("footnotes", none)).withColumn("type", F.when(F.col("type").isin("caption", "footnote"), "text").otherwise(F.col("type")))


def promoted_captions(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Text right after a picture or table that starts like a caption becomes one."""
    w = Window.partitionBy(*keys).orderBy("idx")
    starts = F.lower(F.trim("text")).rlike(r"^(?:表|图|table|fig|chart)")
    return blocks.withColumn("type", F.when((F.col("type") == "text") & F.lag("type").over(w).isin(*MAIN) & starts, "caption").otherwise(F.col("type")))
