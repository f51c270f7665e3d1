import random

from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm.trie_join import near_components
from foliant.plans.shared import materialise

from .conftest import SCHEMA, prose, rows


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(17)
    leak = prose(rng, 30)
    data = [(i, prose(rng, rng.randint(30, 90)), "en", f"s{i % 4}", 0) for i in range(120)]
    data += [(200 + i, data[i][1], "en", "s0", 0) for i in range(10)]
    data += [(300, "12345 !!", "en", "s1", 0), (301, None, None, None, None), (302, prose(rng, 40) + " " + leak + " " + prose(rng, 9), "en", "s2", 0)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id for r in docs.collect()})
    assert 300 not in seen[0] and None not in seen[0] and len(seen[0]) == 131
    assert seen[1] == seen[0] - set(range(200, 210))
    assert seen[2] == seen[1] - {302}
    assert seen[3] <= seen[2]
    comp = near_components(docs.distinct())
    assert comp.where("doc_id <> component_id").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and {r.shard for r in out.collect()} <= set(range(8))


def test_near_duplicates_go_by_similarity_of_five_words(spark):
    rng = random.Random(18)
    base = [prose(rng, 60).split() for _ in range(20)]
    data = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):  # one word changed: 51 of 61 shingles are shared
        data.append((100 + i, " ".join(b[:30] + ["zzz"] + b[31:])))
    for i, b in enumerate(base):  # two words far apart: 46 of 66, too few
        data.append((200 + i, " ".join(b[:15] + ["yyy"] + b[16:45] + ["xxx"] + b[46:])))
    docs = spark.createDataFrame([(i, t, "en", "s0", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == set(range(20)) | set(range(200, 220))


def run_on(spark, folder, docs, benchmark=(), labels=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_an_empty_table_and_one_that_is_all_rejected(spark, empty, tmp_path):
    assert run_on(spark, tmp_path / "a", empty).count() == 0
    odd = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(["123", None, "", "?!"] * 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert run_on(spark, tmp_path / "b", odd).count() == 0


def test_null_ids_clashing_columns_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(19)
    leak, copy, long = prose(rng, 30), prose(rng, 50), prose(rng, 40_000)
    pairs = [(i, prose(rng, rng.randint(30, 60))) for i in range(60)]
    pairs += [(None, copy), (None, copy), (60, copy), (61, long), (None, prose(rng, 20) + " " + leak), (62, prose(rng, 30)), (62, prose(rng, 31))]
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.coalesce("source", F.lit("s9")))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        (tmp_path / name).mkdir()
        spark.createDataFrame([(0, leak)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        at = materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        if name == "near_duplicates":  # of the three copies the one that has an id
            assert sorted((r.doc_id or -1) for r in at.where(F.col("text") == copy).collect()) == [60]
            assert at.where("doc_id = 62").count() == 2 and at.where(F.col("text") == long).count() == 1
        if name == "decontamination":
            assert at.where(F.col("text").contains(leak)).count() == 0 and at.count() == 64
        if name == "mixing":
            assert at.select("size", "target").distinct().count() == 1  # the caller's own columns
    out = corpus_pipeline.sharding(spark, at, str(tmp_path))
    assert out.count() == at.count() > 0
