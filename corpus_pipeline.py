"""The corpus pipeline: documents go through five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import langid
from foliant.llm.decontaminate import decontaminated
from foliant.llm.mixing import laid_out
from foliant.llm.sharding import shard
from foliant.llm.similar import similar_dedup
from foliant.plans.shared import give_back, materialise, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language ID rejects: no letters, or unlike every language learned here.

    Null, empty and letterless texts go; very long ones are scored whole;
    repeated rows share a fate and stay as often as they came; null ids stay;
    an empty table, or one without a labelled text, gives no rows. All
    columns of the input are kept as they are.
    """
    ship(spark)
    give_back(spark)
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word Jaccard similarity of at least 0.8 connects.

    The SimHash trie join gives the close pairs, which are verified exactly;
    pairs that are similar but further apart in their fingerprints are
    completed over rare shingles and verified the same way. The row of the
    smallest doc_id stays (null ids last, of one doc_id's texts the least by
    hash, of equal rows one). Null and wordless texts are one group; very
    long texts are compared whole; an empty table gives no rows; columns of
    any name are kept.
    """
    ship(spark)
    give_back(spark)
    return similar_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text holds a passage of the benchmark.

    Each row is judged by its text, whatever its doc_id: null ids and rows
    that repeat one are no exception. Null and empty texts stay; very long
    texts are looked through whole; an empty benchmark takes nothing away;
    columns of any name are kept.
    """
    ship(spark)
    give_back(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as it is drawn.

    The splitting tree's shards are how the rows lie: each in partitions (so
    files) of its own, shuffled inside. Texts without words are never drawn;
    a null source is a source; rows that repeat a doc_id and a size are drawn
    alike; an empty table gives no rows; columns of any name are kept.
    """
    ship(spark)
    give_back(spark)
    return laid_out(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; equal texts share a shard.

    Null texts count as empty; repeated rows, null ids and the draws of one
    document each get a slot; very long texts are only measured and hashed;
    of groups of one size the order is by hash; an empty table gives no rows;
    other columns are not read.
    """
    ship(spark)
    give_back(spark)
    return shard(docs).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has no Kneser-Ney model; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
