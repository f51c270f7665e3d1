import random
import re

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import langid, toxicity

from .conftest import SCHEMA, rows

ALPHABETS = {"aa": "abcdeo", "bb": "stuvwo", "cc": "éàçùlo"}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


def kneser_ney(texts, order=5):
    """Interpolated Kneser-Ney by dictionaries: a function (context, character) -> probability."""
    count = {}
    for t in texts:
        codes, places, _ = langid.characters([t])
        s = "".join(map(chr, codes.tolist()))
        for p in places.tolist():
            g = s[p - order + 1 : p + 1]
            count[g] = count.get(g, 0) + 1
    levels = {order: count}
    for n in range(order - 1, 0, -1):
        kinds = {}
        for g in levels[n + 1]:
            kinds[g[1:]] = kinds.get(g[1:], 0) + 1
        levels[n] = kinds
    return levels


def test_probabilities_equal_a_plain_model():
    rng = random.Random(13)
    texts = [speak(rng, "aa", 30) for _ in range(5)]
    levels = kneser_ney(texts)
    grams = np.array([[ord(c) for c in g] for g in levels[5]], np.uint32)
    model = langid.Model(["aa"], [grams], [np.array(list(levels[5].values()))])
    letters = len(levels[1])

    def p(ctx, c):
        if not ctx and not levels[1]:
            return 1 / (letters + 1)
        n = len(ctx) + 1
        lower = 1 / (letters + 1) if n == 1 else p(ctx[1:], c)
        table = {g: k for g, k in levels[n].items() if g[:-1] == ctx}
        if not table:
            return lower
        once, twice = sum(v == 1 for v in levels[n].values()), sum(v == 2 for v in levels[n].values())
        d = once / (once + 2 * twice) if once else 0.5
        total = sum(table.values())
        return max(table.get(ctx + c, 0) - d, 0) / total + d * len(table) / total * lower

    for t in (texts[0], "abba zeta", "q"):
        codes, places, counts = langid.characters([t])
        s = "".join(map(chr, codes.tolist()))
        want = -sum(np.log(p(s[k - 4 : k], s[k])) for k in places.tolist()) / counts[0]
        got, n = model.entropies([t])
        assert n[0] == counts[0] and abs(got[0, 0] - want) < 1e-4
    assert abs(sum(p("abc", c) for c in {g[-1] for g in levels[1]}) + p("abc", "~") - 1) < 1e-9


def test_hash_array():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    a = langid.HashArray(keys)
    at, found = a.find(np.concatenate([keys, keys + np.uint64(1)]))
    assert found[: len(keys)].all() and not found[len(keys) :].any() and (at[: len(keys)] == np.arange(len(keys))).all()
    assert not langid.HashArray(np.zeros(0, np.uint64)).find(keys)[1].any()


def languages(spark):
    rng = random.Random(14)
    data = []
    for i in range(240):
        lang = sorted(ALPHABETS)[i % 3]
        data.append((i, speak(rng, lang, rng.randint(3, 60)), lang, "s", 0, 0, 0.0, 0, 0, 0, 0.0, "", "", ""))
    return spark.createDataFrame(data, SCHEMA)


def test_languages_are_told_apart_and_strangers_rejected(spark, edge, empty):
    docs = languages(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 238 and not any(r.rejected for r in got)
    odd = spark.createDataFrame(rows([(1, "zzzz qqqq xxxx jjjj zqxj " * 40), (2, None), (3, "12 !!"), (4, "")]), SCHEMA)
    out = {r.doc_id: r for r in langid.identify(odd, model, ["doc_id"]).collect()}
    assert out[1].rejected and out[1].lang_pred in ALPHABETS
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and out[i].rejected for i in (2, 3, 4))
    assert langid.accepted(odd, model).columns == odd.columns and langid.accepted(odd, model).count() == 0
    assert langid.identify(edge, model, ["doc_id"]).count() == 12
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    nothing = langid.train(empty)
    assert all(r.lang_pred == "und" for r in langid.identify(edge, nothing, ["doc_id"]).collect())


def test_a_document_is_scored_alike_alone_and_in_a_batch(spark):
    model = langid.train(languages(spark))
    texts = [r.text for r in languages(spark).limit(20).collect()]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]


def test_held_out_rows_are_not_learned(spark):
    docs = languages(spark)
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spoiled = docs.withColumn("text", F.when(hidden, F.lit("zzz")).otherwise(F.col("text")))
    a, b = langid.train(docs), langid.train(spoiled)
    assert all((x == y).all() for x, y in zip(a.tables[0].logp, b.tables[0].logp))


def test_any_number_of_languages(monkeypatch):
    """Tables of a few languages side by side give what one table of all gives."""
    rng = random.Random(20)
    names = [f"l{k:02}" for k in range(11)]
    texts = {n: [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k : k + 8]) for _ in range(5)) for _ in range(40))] for k, n in enumerate(names)}
    grams, counts = [], []
    for n in names:
        full = kneser_ney(texts[n])[5]
        grams.append(np.array([[ord(c) for c in g] for g in full], np.uint32))
        counts.append(np.array(list(full.values())))
    one = langid.Model(names, grams, counts)
    monkeypatch.setattr(langid, "BESIDE", 4)
    few = langid.Model(names, grams, counts)
    some = [texts[n][0] for n in names] + ["", "zz 99"]
    assert (len(one.tables), len(few.tables)) == (1, 3)
    assert np.allclose(one.entropies(some)[0], few.entropies(some)[0])
    assert [p[0] for p in few.predict(some)][: len(names)] == names


def labelled(spark, n=400):
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(n):
        words = [speak(rng, "aa", 1) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["moronic", "idiotes", "scumbag"])
        if toxic and i % 2 == 0 or rng.random() < 0.02:
            words.append("muslims")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (0, None, None), (10**6, 0, 1)]
    return spark.createDataFrame(rows(docs), SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned_and_group_names_are_not(spark, edge, empty):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id is not null").collect()}
    got = [(truth[r.doc_id], r.score >= 0.3) for r in toxicity.scores(docs, model).collect()]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)
    neutral = "abc doe muslims bad"
    swapped = [model.score(neutral.replace("muslims", t)) for t in ("women", "jews", "atheists")]
    assert model.score("you are a scumbag") > 0.3 and model.score(neutral) < 0.3
    assert max(abs(model.score(neutral) - s) for s in swapped) < 0.15
    assert toxicity.scores(edge, model).count() == 12 and toxicity.scores(empty, model).count() == 0
    blank = [r.score for r in toxicity.scores(edge, model).where("doc_id in (1, 2, 3)").collect()]
    assert len(set(blank)) == 1 and blank[0] < 0.3


def loss(w, b, active, y, swaps, prior, l2, pull):
    """The objective, written out."""
    total = 0.0
    for a, t in zip(active, y):
        z = b + sum(w[k] for k in a)
        total += np.logaddexp(0, z) - t * z
    total /= len(y)
    if swaps:
        total += pull * sum((sum(w[k] for k in gain) - sum(w[k] for k in lose)) ** 2 for gain, lose in swaps) / len(swaps)
    return total + l2 * sum((w - prior) ** 2)


def test_the_fit_is_the_minimum():
    """No small step from the fit, along any weight, makes the written-out objective less."""
    rng = random.Random(21)
    n = 8
    active = [sorted({rng.randrange(n) for _ in range(rng.randint(0, 4))}) for _ in range(120)]
    y = np.array([float(rng.random() < (0.8 if 1 in a else 0.2)) for a in active])
    swaps = [([2], [3]), ([4, 5], [1])]
    prior = np.array([rng.random() for _ in range(n)])
    w, b = toxicity.fit(active, y, swaps, prior, l2=0.01, pull=2.0, steps=4000)
    here = loss(w, b, active, y, swaps, prior, 0.01, 2.0)
    for k in range(n):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b, active, y, swaps, prior, 0.01, 2.0) > here
    assert min(loss(w, b + s, active, y, swaps, prior, 0.01, 2.0) for s in (-0.05, 0.05)) > here


def test_scores_equal_the_sum_of_all_features(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scores(docs, model).collect():
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", texts[r.doc_id])}
        have = {f for w in words for f in [w, *[w[:k] + "*" for k in (4, 5, 6) if len(w) > k]]}
        z = model.bias + sum(v for f, v in model.weights.items() if f in have)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_counterfactuals_stay_in_their_sentence():
    got = toxicity.counterfactuals("The women sang. Men and men danced! Nobody else")
    assert len(got) == 22 and all(lose <= {"women", "wome*", "men"} for _, lose in got)
    assert ({"jews"}, {"men"}) in got and ({"jews"}, {"women", "wome*"}) in got
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals("") == []


def test_pull_towards_equal_scores():
    active = [[0], [0], [1], []] * 10
    y = np.array([1.0, 1.0, 0.0, 0.0] * 10)
    free, _ = toxicity.fit(active, y, [], np.zeros(2))
    tied, _ = toxicity.fit(active, y, [([1], [0])], np.zeros(2), pull=50.0)
    assert free[0] - free[1] > 2 and abs(tied[0] - tied[1]) < 0.5


def test_without_labels_the_score_is_flat(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r.score, 3) for r in toxicity.scores(edge, toxicity.train(edge, labels)).collect()} == {0.0}
