import random

import numpy as np

from foliant.llm.similar import prefix, shingles, similar_components, similar_dedup

from .conftest import SCHEMA, prose, rows, word


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(pairs):
    """Smallest id of each id's group, all pairs compared."""
    label = {i: i for i, _ in pairs}
    sets = [(i, grams(t)) for i, t in pairs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or (a or b) and len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((label[i], label[j]))
                label = {d: x if c == y else c for d, c in label.items()}
    return label


def least(comp):
    """Smallest doc_id of each row's group, by doc_id."""
    got = comp.collect()
    first = {}
    for r in got:
        if r.doc_id is not None:
            first[r.root] = min(first.get(r.root, r.doc_id), r.doc_id)
    return {r.doc_id: first.get(r.root) for r in got}


def changed(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = word(rng)
    return " ".join(words)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    common = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64))
    counts = rng.integers(1, 9, 50)
    for n in (1, 2, 5, 9, 40):
        for _ in range(50):
            pool = np.unique(np.concatenate([rng.choice(common, n), rng.integers(0, 2**63, n).astype(np.uint64)]))
            a, b = (np.sort(rng.choice(pool, min(len(pool), n), replace=False)) for _ in range(2))
            same = len(np.intersect1d(a, b))
            if same / (len(a) + len(b) - same) >= 0.8:
                assert len(np.intersect1d(prefix(a, common, counts), prefix(b, common, counts)))


def test_shingles_are_a_set():
    assert len(shingles(b"a b c d e f a b c d e")) == 6 and len(shingles(b"a b a b a b a b")) == 2
    assert len(shingles(b"one two")) == 1 and len(shingles(None)) == len(shingles(b" \n")) == 0
    assert (shingles(b"A  b C") == shingles(b"a b c")).all()


def test_components_equal_brute_force(spark, corpus):
    pairs = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    rng = random.Random(7)
    for k in range(60):
        pairs.append((1000 + k, changed(rng, pairs[k][1], min(3, len(pairs[k][1].split())) if k % 3 else 1)))
    group = prose(rng, 70)
    pairs += [(2000 + k, changed(rng, group, rng.randint(1, 3))) for k in range(60)]  # over one shingle's few
    docs = spark.createDataFrame(rows(pairs), SCHEMA).repartition(4)
    want = components(pairs)
    for few in (32, 2):
        assert least(similar_components(docs, few=few)) == want
    assert sorted(r.doc_id for r in similar_dedup(docs).collect()) == sorted(set(want.values()))


def test_edge_rows(edge, empty):
    by = least(similar_components(edge))
    assert by[1] == by[2] == by[3] == 1 and by[4] == 4 and by[5] == by[6] == by[7] == by[None] == 5
    kept = similar_dedup(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == [1, 4, 5, 8, 9, 10]
    assert similar_components(empty).count() == similar_dedup(empty).count() == 0


def test_a_text_without_an_id_connects(spark):
    rng = random.Random(8)
    w = prose(rng, 60).split()
    a, mid, b = (" ".join(w[:10] + x + w[11:50] + y + w[51:]) for x, y in ((["p"], ["q"]), (["r"], ["q"]), (["r"], ["s"])))
    docs = spark.createDataFrame(rows([(1, a), (None, mid), (2, b)]), SCHEMA)
    assert components([(1, a), (2, b)]) == {1: 1, 2: 2}
    assert len({r.root for r in similar_components(docs).collect()}) == 1
    assert [r.doc_id for r in similar_dedup(docs).collect()] == [1]


def test_rows_that_share_an_id_are_told_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame(rows([(1, a), (2, a), (2, b), (None, c), (None, c), (None, b), (3, ""), (4, None)]), SCHEMA)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in similar_dedup(docs).collect()) == sorted([(False, 1, a), (False, 2, b), (True, 0, c), (False, 3, "")])


def test_the_driver_gives_back_broadcasts_between_steps(spark, corpus, monkeypatch):
    import time

    from pyspark.sql import functions as F

    from foliant.llm import similar

    stored = spark.sparkContext._jsc.sc().env().memoryManager().storageMemoryUsed
    give_back, steps = similar.give_back, []

    def option():
        of = spark._jvm.java.lang.Class.forName
        kind = of("com.sun.management.HotSpotDiagnosticMXBean")
        types, values = (spark.sparkContext._gateway.new_array(x, 1) for x in (spark._jvm.java.lang.Class, spark._jvm.java.lang.Object))
        types[0], values[0] = of("java.lang.String"), "MaxHeapFreeRatio"
        return kind.getMethod("getVMOption", types).invoke(spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind), values).getValue()

    was = option()
    before = stored()
    for k in range(8):
        assert spark.range(1000).join(F.broadcast(spark.range(k, 50_000)), "id").count()
    held = stored() - before
    give_back(spark)
    for _ in range(50):
        if stored() < before + held // 2:
            break
        time.sleep(0.2)
    assert stored() < before + held // 2 or held <= 0
    assert option() == was

    monkeypatch.setattr(similar, "give_back", lambda s: (give_back(s), steps.append(s)))
    got = {(r.doc_id, r.t1): r.root for r in similar_components(corpus).collect()}
    assert len(got) == 300 and len(steps) > 10
