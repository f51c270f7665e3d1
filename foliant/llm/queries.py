"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, licenses, main_text, toxicity
from foliant.llm.decontaminate import leaks
from foliant.llm.media import media_columns
from foliant.llm.mixing import mix
from foliant.llm.sharding import shard
from foliant.llm.token_files import token_documents
from foliant.llm.trie_join import near_components

#: The folder of public tokenizer files is a parameter of token_documents.
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("starts")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 6))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def _held_out(mod: int, rest: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest).alias("held_out")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.train(docs), ["doc_id"])
    return out.select("doc_id", _held_out(5, 0), "lang_pred", "score", "rejected", "entropy")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_media_columns, op2_main_text, op3_token_files, op4_license_scan, op5_decontamination,
        op6_mixing, op7_language_id, op8_toxicity, op9_sharding, op10_simhash_components,
    )
}

#: Every window that shares a shingle with an item against every such item; other queries hash or learn as SQL can't.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT ws, list_sort(list(item_id)) AS item_ids FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0 GROUP BY ws),
i AS (SELECT row_number() OVER () AS item, * FROM b),
dg AS (SELECT doc_id, k, array_to_string(ws[k + 1 : k + 5], ' ') AS g FROM d, unnest(range(0, greatest(len(ws) - 4, least(len(ws), 1)))) u(k) WHERE len(ws) > 0),
ig AS (SELECT item, len(ws) AS n, k, array_to_string(ws[k + 1 : k + 5], ' ') AS g FROM i, unnest(range(0, greatest(len(ws) - 4, 1))) u(k)),
places AS (SELECT DISTINCT doc_id, dg.k - ig.k AS start, n FROM dg JOIN ig USING (g)),
windows AS (SELECT DISTINCT doc_id, ws[greatest(start, 0) + 1 : start + n] AS w FROM places JOIN d USING (doc_id)),
single AS (SELECT row_number() OVER () AS wid, w FROM (SELECT DISTINCT w FROM windows WHERE len(w) > 0)),
wg AS (SELECT wid, array_to_string(w[k + 1 : k + 5], ' ') AS g, count(*) AS c FROM single, unnest(range(0, greatest(len(w) - 4, 1))) u(k) GROUP BY wid, 2),
ic AS (SELECT item, g, count(*) AS c FROM ig GROUP BY item, g),
wt AS (SELECT g, 1 + ln((SELECT count(*) FROM i) / count(*)) AS weight FROM ic GROUP BY g),
tot AS (SELECT item, sum(c * weight) AS total FROM ic JOIN wt USING (g) GROUP BY item),
sim AS (SELECT wid, ic.item, sum(least(wg.c, ic.c) * weight) / any_value(total) AS similarity FROM wg JOIN ic USING (g) JOIN wt USING (g) JOIN tot ON tot.item = ic.item GROUP BY wid, ic.item HAVING sum(least(wg.c, ic.c) * weight) / any_value(total) >= 0.8 - 1e-9),
hit AS (SELECT doc_id, wid, similarity, unnest(item_ids) AS item_id FROM sim JOIN single USING (wid) JOIN windows USING (w) JOIN i ON i.item = sim.item)
SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, round(max(similarity), 6) AS similarity, count(DISTINCT wid) AS n_windows FROM hit GROUP BY doc_id""",
}
