import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliant.llm.trie_join import fingerprint, near_components, near_dedup, near_links, tables, trie_links
from foliant.operators.components import connected_components


def brute(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(fps, budget=3):
    """Component label by index, all pairs compared."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint_is_the_majority_of_shingle_hashes():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice("abcdefgh") for _ in range(n))
        assert fingerprint(text.encode()) == brute(text)
    assert fingerprint("A b C".encode()) == brute("a b C")


def test_trie_join_connects_all_pairs_within_the_budget():
    rng = random.Random(4)
    base = [rng.getrandbits(48) for _ in range(40)]
    keys = sorted({b ^ sum(1 << rng.randrange(48) for _ in range(rng.randint(0, 3))) for b in base for _ in range(6)})
    rest = np.array(keys, np.uint64)
    n = len(rest)
    roots = tuple(np.array([x]) for x in (0, n, 0, n, 0))
    for most in (1 << 20, 8):
        of = trie_links(rest, roots, 48, 3, most)
        want = groups(keys)
        assert {tuple(np.flatnonzero(of == c)) for c in set(of.tolist())} == {tuple(i for i in range(n) if want[i] == c) for c in set(want)}


def test_crowded_blocks_are_split_without_loss(spark):
    rng = random.Random(5)
    top = 0x1234 << 48
    fps = sorted({top | (rng.getrandbits(48) & rng.getrandbits(48) & rng.getrandbits(48) & rng.getrandbits(48)) for _ in range(300)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for crowded, least_k in ((50, 1), (3, 1), (10**6, 1), (10**6, 2), (50, 3)):
        links = near_links(spark.createDataFrame(signed, "fp long"), 3, crowded, least_k)
        got = {r.node: r.component for r in connected_components(links).collect()}
        label = [got.get(s[0], s[0]) for s in signed]
        want = groups(fps)
        pairs = set(zip(label, want))
        assert len(pairs) == len(set(label)) == len(set(want))


def test_any_near_pair_meets_in_some_table():
    rng = random.Random(6)
    for budget, n, k in ((3, 10**6, 1), (3, 10**11, 2), (3, 10**14, 3), (1, 10**12, 1)):
        sets = tables(budget, n, 50_000)
        assert all(sum(w for _, w in key) + sum(w for _, w in rest) == 64 and len(key) == k for key, rest in sets)
        for _ in range(200):
            f = rng.getrandbits(64)
            diff = sum(1 << b for b in rng.sample(range(64), budget))
            assert any(all(not diff >> s & ((1 << w) - 1) for s, w in key) for key, _ in sets) and f ^ diff != f


def test_components_equal_brute_force(corpus):
    docs = {r.doc_id: r.text for r in corpus.select("doc_id", "text").collect()}
    ids = sorted(docs)
    fps = [brute(docs[i]) for i in ids]
    want = dict(zip(ids, [ids[x] for x in groups(fps)]))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in near_components(corpus).collect()}
    assert got == {i: (f, want[i]) for i, f in zip(ids, fps)}


def test_edge_rows(edge, empty):
    got = [(r.doc_id, r.fp, r.component_id) for r in near_components(edge).collect()]
    assert len(got) == 12
    by = {i: c for i, _, c in got if i is not None}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[5] == 5 and by[4] == 4
    assert [c for i, _, c in got if i is None] == [5]
    assert near_components(empty).count() == 0


def test_dedup_keeps_one_of_each_group_and_all_columns(edge, empty, corpus):
    kept = near_dedup(edge)
    assert kept.columns == edge.columns
    ids = sorted([r.doc_id for r in kept.collect()], key=str)
    assert ids.count(4) == 1 and not {2, 3, 6, None} & set(ids)
    assert near_dedup(empty).count() == 0
    comp = near_components(corpus)
    assert {r.doc_id for r in near_dedup(corpus).collect()} == {r.doc_id for r in comp.where(F.col("doc_id") == F.col("component_id")).collect()}
