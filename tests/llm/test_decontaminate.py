import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from foliant.llm.decontaminate import FLIPS, RADIUS, _blocks, decontaminated, leaks, simhash

from .conftest import SCHEMA, prose, rows


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def grams(w):
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(docs, items, threshold=0.8):
    """Every window of an item's length against the item."""
    norm = {}
    for i, t in items:
        if words(t):
            norm.setdefault(tuple(words(t)), []).append(i)
    df = Counter(g for w in norm for g in grams(list(w)))
    weight = {g: 1 + math.log(len(norm) / n) for g, n in df.items()}
    found = {}
    for d, t in docs:
        w = words(t)
        for item, ids in norm.items():
            want = grams(list(item))
            total = sum(n * weight[g] for g, n in want.items())
            if len(item) < 5 and list(item) != w:
                continue  # a short item is one shingle and matches whole texts only
            for s in range(1 - len(item), len(w)):
                have = grams(w[max(0, s) : max(0, s + len(item))])
                if sum(min(n, have[g]) * weight[g] for g, n in want.items()) >= threshold * total - 1e-9:
                    found.setdefault(d, set()).update(ids)
                    break
    return {d: sorted(i) for d, i in found.items()}


def test_matches_brute_force(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(12, 40))) for k in range(20)] + [(20, "Three words only"), (21, None), (22, "!!"), (23, "")]
    items.append((24, items[0][1].upper()))
    docs = []
    for k in range(80):
        t = prose(rng, rng.randint(0, 60))
        if k % 3 == 0:
            p = items[k % 20][1].split()
            if k % 2:
                p[len(p) // 2] = "changed"
            t += ". " + " ".join(p).title() + "! " + prose(rng, 10)
        docs.append((k, t))
    docs += [(100, "three WORDS only"), (101, "has three words only inside"), (102, None), (103, ""), (103, items[3][1]), (None, items[4][1])]
    df = spark.createDataFrame(rows(docs), SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in leaks(df, bench).collect()}
    assert got == brute(docs, items)
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns
    gone = brute(list(enumerate(t for _, t in docs)), items)
    left = sorted((d is not None, d or 0, t or "") for k, (d, t) in enumerate(docs) if k not in gone)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect()) == left
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def test_blocks_reach_all_fingerprints_within_the_radius(spark):
    rng = random.Random(7)
    pairs = []
    for k in range(200):
        f = rng.getrandbits(63)
        g = f
        for b in rng.sample(range(63), RADIUS):
            g ^= 1 << b
        pairs.append((k, f, g))
    df = spark.createDataFrame(pairs, "k int, f long, g long")
    a = df.select("k", F.explode(_blocks("f", FLIPS)).alias("b"))
    b = df.select(F.col("k").alias("j"), F.explode(_blocks("g", 0)).alias("c"))
    assert a.join(b, (F.col("k") == F.col("j")) & (F.col("b") == F.col("c"))).select("k").distinct().count() == 200


def test_part_quotes_are_found_at_the_threshold(spark):
    """Windows that just reach 80 % of an item's shingles: its head, tail, middle, or two ends around foreign words."""
    rng = random.Random(8)
    items, docs = [], []
    for n in (15, 20, 30, 40, 60, 90, 120):
        for k in range(24):
            w = prose(rng, n).split()
            items.append((len(items), " ".join(w)))
            share = -(-8 * (n - 4) // 10) + 4  # words that hold 80 % of the shingles
            cut = {0: w[:share], 1: w[-share:], 2: w[(n - share) // 2 : (n - share) // 2 + share]}.get(k % 4)
            if cut is None:
                cut = list(w)
                cut[n // 2] = "changed"
                if 5 / (n - 4) > 0.2:
                    cut = w[:share]
            docs.append((len(docs), f"{prose(rng, 70)}. {' '.join(cut)}. {prose(rng, 70)}"))
    clean = [(10_000 + k, prose(rng, 200)) for k in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in leaks(spark.createDataFrame(rows(docs + clean), SCHEMA).repartition(4), bench).collect()}
    assert all(ids == [d] for d, ids in got.items())
    for first in range(0, len(docs), 24):
        assert sum(d in got for d in range(first, first + 24)) >= 23  # of 24 at each length


def test_simhash_is_the_weighted_majority(spark):
    rng = random.Random(8)
    for n in (1, 2, 7, 40):
        grams = [(rng.getrandbits(63) - (1 << 62), rng.randint(1, 3), rng.choice([1.0, 2.5])) for _ in range(n)]
        got = spark.createDataFrame([(grams,)], "g array<struct<h:long,n:long,weight:double>>").select(simhash("g").alias("f")).first().f
        want = sum((sum((1 if h >> b & 1 else -1) * m * w for h, m, w in grams) > 0) << b for b in range(64))
        assert got & (2**64 - 1) == want
