import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm.mixing import _sized, free_names, laid_out, mix, mixed_rows, targets
from foliant.llm.sharding import CapacityTree, best_fit_decreasing, pack, shard
from foliant.plans.shared import buckets_for


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    rng = random.Random(10)
    for n in (1, 2, 7, 30):
        sizes = {f"s{k:02}": rng.randint(0, 1000) * rng.choice([1, 1, 30]) for k in range(n)} | ({None: 50} if n > 2 else {})
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = water(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s])


@pytest.mark.parametrize("per_block", [4, 4096])
def test_each_source_comes_to_its_target(corpus, per_block):
    corpus = corpus.select("doc_id", "text", "source")
    rows = mix(corpus, rows_per_block=per_block).collect()
    assert len(rows) == corpus.count()
    taken, target = Counter(), {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        assert sum(d.words for d in r.draws) == r.taken and all(0 <= d.shard < 8 for d in r.draws)
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= 40  # equal rows share a cut
    again = mix(corpus.repartition(7), rows_per_block=per_block)
    assert sorted((r.doc_id, r.taken, str(r.draws)) for r in again.collect()) == sorted((r.doc_id, r.taken, str(r.draws)) for r in rows)


def test_shards_get_equal_numbers_of_draws(corpus):
    rows = mix(corpus.drop("size", "target"), rows_per_block=4, n_shards=4).collect()
    blocks = Counter()
    for r in rows:
        for d in r.draws:
            blocks[d.shard] += 1
    assert set(blocks) == {0, 1, 2, 3}


def test_mix_edges(edge, empty):
    rows = mix(edge).collect()
    assert len(rows) == 12 and all(r.mix_taken == 0 for r in rows if not r.mix_size)
    assert mix(edge).columns == edge.columns + ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_draws"]
    kept = sorted(str(tuple(r)) for r in edge.collect())
    assert sorted(str(tuple(r)[: len(edge.columns)]) for r in rows) == kept  # clashing columns keep their values
    assert mix(empty).count() == 0 and mixed_rows(empty).count() == 0 and laid_out(empty).count() == 0
    drawn = mixed_rows(edge)
    assert drawn.columns == edge.columns + ["mix_shard", "mix_key"]
    assert {str(tuple(r)[: len(edge.columns)]) for r in drawn.collect()} <= set(kept)
    assert sorted(str(tuple(r)) for r in laid_out(edge).collect()) == sorted(str(tuple(r)[: len(edge.columns)]) for r in drawn.collect())


def test_clashing_names_that_are_taken_twice():
    assert free_names(["size", "key"], ["doc_id"]) == {"size": "size", "key": "key"}
    assert free_names(["size", "key"], ["SIZE", "mix_key"]) == {"size": "mix_mix_size", "key": "mix_mix_key"}


def test_written_partitions_hold_shuffled_shards(corpus):
    rows = mixed_rows(corpus.drop("shard"), n_shards=4, rows_per_block=4)
    want = defaultdict(list)
    for r in rows.collect():
        want[r.shard].append((r.key, r.doc_id))
    out = laid_out(corpus.drop("shard"), n_shards=4, rows_per_block=4)
    parts = defaultdict(list)
    for r in out.select("doc_id", F.spark_partition_id().alias("p")).collect():
        parts[r.p].append(r.doc_id)
    runs = {tuple(i for _, i in sorted(v)) for v in want.values()}
    assert sum(map(len, parts.values())) == sum(map(len, runs))
    for ids in parts.values():  # each partition is the shards' shuffled runs, or parts of them, end to end
        at = 0
        for run in sorted(want):
            order = [i for _, i in sorted(want[run])]
            mine = ids[at:]
            k = 0
            for i in order:
                if k < len(mine) and mine[k] == i:
                    k += 1
            at += k
        assert at == len(ids)


def test_a_block_has_a_bounded_number_of_rows(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("hot").alias("source"))
    for per_block in (512, 4096):
        blocks = buckets_for(60_000, per_block, 16)
        most = _sized(df, 17).groupBy(F.pmod("__h", F.lit(blocks))).count().agg(F.max("count")).first()[0]
        assert most <= 1.3 * per_block


def test_tree_finds_the_tightest_bin():
    rng = random.Random(11)
    tree, model = CapacityTree(), set()
    for k in range(3000):
        if model and rng.random() < 0.45:
            key = rng.choice(sorted(model))
            tree.remove(key)
            model.discard(key)
        else:
            key = (rng.randint(0, 200), k)
            tree.add(key)
            model.add(key)
        size = rng.randint(0, 210)
        assert tree.tightest(size) == min((m for m in model if m[0] >= size), default=None)


def one_by_one(sizes, capacity):
    """The bin of each of ``sizes`` (largest first), all open bins looked at for each item."""
    room, out = [], []
    for s in sizes:
        best = min((k for k in range(len(room)) if room[k] >= s), key=lambda k: (room[k], k), default=None)
        if best is None:
            room.append(max(capacity, s))
            best = len(room) - 1
        room[best] -= s
        out.append(best)
    return out


def classes(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def spread(runs):
    return [b for _, b, n in runs for _ in range(n)]


def test_best_fit_decreasing_by_classes_is_that_of_single_items():
    assert best_fit_decreasing([(7, 1), (5, 2), (3, 1)], 10) == [(0, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert best_fit_decreasing([(12, 1), (3, 1)], 10) == [(0, 0, 1), (1, 1, 1)]
    assert best_fit_decreasing([(7, 4)], 10, 3) is None
    rng = random.Random(12)
    for _ in range(30):
        sizes = sorted((rng.randint(1, rng.choice([5, 40, 100])) for _ in range(rng.randint(1, 400))), reverse=True)
        capacity = rng.randint(50, 120)
        assert spread(best_fit_decreasing(classes(sizes), capacity)) == one_by_one(sizes, capacity)


def loads(sizes, bins):
    load, of = Counter(), classes(sizes)
    for k, b, n in pack(of, bins):
        load[b] += of[k][0] * n
    assert sum(load.values()) == sum(sizes) and set(load) <= set(range(bins))
    return load


def test_pack_is_even_and_gives_a_giant_its_own_bin():
    load = loads([1000] + [3] * 300 + [7] * 50, 8)
    rest = sorted(v for v in load.values() if v < 1000)
    assert max(load.values()) == 1000 and rest[-1] - rest[0] <= 10 and len(load) == 8
    assert pack([], 8) == [] and pack([(5, 1)], 1) == [(0, 0, 1)] and len(loads([9, 9, 9], 8)) == 3
    rng = random.Random(15)
    for n in (100, 5000, 200_000):
        load = loads([int(rng.lognormvariate(6, 1)) + 1 for _ in range(n)], 8)
        assert max(load.values()) <= 1.001 * sum(load.values()) / 8 + 1000 * (n == 100)


def check(df):
    rows = shard(df).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    slots, place = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        place[r.k1, r.k2].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in place.values())
    return rows


def test_shards(corpus, edge, empty):
    rows = check(corpus)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert set(load) == set(range(8))
    own = defaultdict(int)
    for r in rows:
        own[r.k1, r.k2] += r.size
    giant = max(own.values())
    even = sorted(v for v in load.values() if v != giant) if giant * 8 > sum(load.values()) else sorted(load.values())
    assert even[-1] <= 1.01 * sum(even) / len(even)
    check(edge)
    assert shard(empty).count() == 0


def test_many_groups_are_all_packed(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.expr("case when id % 3 = 0 then 'copy' else repeat('x', cast(id % 97 as int)) || id end").alias("text"))
    got = shard(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    mean = sum(r.b for r in got) / 8
    assert len(got) == 8 and all(abs(r.b - mean) < 0.001 * mean and r.m == r.n - 1 for r in got)
