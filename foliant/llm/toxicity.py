"""Toxicity by a logistic classifier with counterfactual regularisation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import side

# Neutral names of groups; a term may be swapped for another of its row.
IDENTITY_TERMS = (
    ("women", "men", "gays", "lesbians", "immigrants", "refugees", "muslims", "christians", "jews", "buddhists", "hindus", "atheists"),
    ("woman", "man", "gay", "lesbian", "immigrant", "refugee", "muslim", "christian", "jew", "buddhist", "hindu", "atheist"),
    ("black", "white", "asian", "african", "european", "american", "arab", "latino", "disabled", "deaf", "blind", "elderly"),
    ("frauen", "männer", "schwule", "lesben", "einwanderer", "flüchtlinge", "muslime", "christen", "juden", "behinderte"),
    ("femmes", "hommes", "homosexuels", "lesbiennes", "immigrés", "réfugiés", "musulmans", "chrétiens", "juifs", "handicapés"),
    ("mujeres", "hombres", "homosexuales", "lesbianas", "inmigrantes", "refugiados", "musulmanes", "cristianos", "judíos", "discapacitados"),
)
_GROUP = {t: row for row in IDENTITY_TERMS for t in row}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
#: A weight starts at, and is drawn to, this share of the feature's log-odds less so many standard errors.
PRIOR, DOUBT = 0.8, 2.5
#: Lengths of word beginnings that are features beside whole words.
STEMS = (4, 5, 6)


def words_in(text: str | None) -> set[str]:
    """The different lower-cased words of a text."""
    return set(_WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def _all(words: set[str]) -> set[str]:
    return {f for w in words for f in features(w)}


def counterfactuals(text: str | None) -> list[tuple[set[str], set[str]]]:
    """(features gained, features lost) by each sentence of the text in which one term of a group gives way to another of its row."""
    out = []
    for sentence in _SENTENCE.split(text or ""):
        words = words_in(sentence)
        named = sorted(words & _GROUP.keys())
        if not named:
            continue
        have = _all(words)
        for w in named:
            rest = _all(words - {w})
            for other in _GROUP[w]:
                if other not in words:
                    new = rest | set(features(other))
                    out.append((new - have, have - new))
    return out


class Classifier:
    """Weights of features that a text has or hasn't; only chosen features have any."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.bias = float(bias)
        self.weights = {f: float(w) for f, w in zip(names, weights) if w}
        least = min(STEMS)
        self.heads = {f.rstrip("*")[:least] for f in self.weights}

    def score(self, text: str | None) -> float:
        """The probability that the text is toxic."""
        found, heads, weights = set(), self.heads, self.weights
        for w in words_in(text):
            if w[:4] in heads:
                found.update(f for f in features(w) if f in weights)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-max(-40.0, min(40.0, z))))


def fit(active: list[list[int]], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], prior: np.ndarray, l2: float = 5e-6, pull: float = 5.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of the logistic loss + l2 |w - prior|^2 + pull x mean (score change of a swap)^2, by Adam.

    ``active``: the features of each text. ``swaps``: for a sentence and its
    counterfactual, the features it gains and loses; the change of its logit
    is what the penalty holds near zero. The prior is a share of each
    feature's own cautious log-odds, so that features that mostly come together still
    count when one comes alone.
    """
    n, n_features = len(labels), len(prior)
    rows = np.repeat(np.arange(n), [len(a) for a in active])
    cols = np.array([c for a in active for c in a], np.int64)
    srows = np.repeat(np.arange(len(swaps)), [len(g) + len(x) for g, x in swaps])
    scols = np.array([c for g, x in swaps for c in (*g, *x)], np.int64)
    signs = np.array([s for g, x in swaps for s in [1.0] * len(g) + [-1.0] * len(x)])
    w, b = prior.copy(), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        off = (p - labels) / n
        g = np.bincount(cols, off[rows], n_features) + 2 * l2 * (w - prior)
        if len(swaps):
            change = np.bincount(srows, signs * w[scols], len(swaps))
            g += np.bincount(scols, 2 * pull * signs * change[srows] / len(swaps), n_features)
        gb = off.sum()
        rate = 0.1 * (1 - t / (steps + 1)) + 0.002
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), most_rows: int = 20_000, least_docs: int = 3, least_z: float = 3.5) -> Classifier:
    """A classifier of ``labels.toxic`` on the texts of ``docs``.

    Learned from a sample of about ``most_rows`` labelled documents (the
    stated bound of the fit), chosen by a hash of the doc_id; documents whose
    crc32(doc_id) mod ``held_out[0]`` is ``held_out[1]`` are left out.
    All features that at least ``least_docs`` toxic texts have and whose
    log-odds are ``least_z`` standard errors up have weights; they are counted
    on the executors. Evidence is for label 1 only: clean words around an
    insult don't take from it. A sentence that names a group (IDENTITY_TERMS)
    gives, for each such term and each other term of its row, the sentence
    with the other term; the change of its score is penalised. Null texts
    have no features. Null toxic labels and null doc_ids are left out; a doc_id with
    several labels counts with each of them. Without both labels the score is
    the share of label 1.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y"))
    if held_out:
        marks = marks.where(F.crc32(F.col("__id").cast("string").cast("binary")) % held_out[0] != held_out[1])
    n = marks.count()
    if n > most_rows:
        lot = F.pmod(F.xxhash64(F.lit(11), "__id"), F.lit(1_000_000)) / 1_000_000.0
        marks = marks.where(lot < most_rows / n)
    chosen = side(marks)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("__id")).select("y", "text")

    def counted(which: int, only):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, rows = Counter(), 0
            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if y == which:
                        rows += 1
                        got = _all(words_in(text))
                        count.update(got if only is None else got & only.value)
            count[""] = rows
            names = list(count)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[x] for x in names], pa.int64())], ["f", "n"])

        return run

    positive = sample.mapInArrow(counted(1, None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.expr(f"n >= {least_docs} or f = ''"))
    # rarer features of toxic texts can't be sure; the rest are bounded by the sample
    pos = {r.f: r.n for r in positive.collect()}
    n_pos = pos.pop("", 0)
    only = spark.sparkContext.broadcast(frozenset(pos))
    neg = {r.f: r.n for r in sample.mapInArrow(counted(0, only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    n_neg = neg.pop("", 0)
    if not n_pos or not n_neg:
        rate = n_pos / max(1, n_pos + n_neg)
        return Classifier([], np.zeros(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    ranked = []
    for f, a in pos.items():
        c = neg.get(f, 0)
        odds = np.log((a + 0.5) / (n_pos - a + 0.5)) - np.log((c + 0.5) / (n_neg - c + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
        if z >= least_z:
            ranked.append((-z, f, max(0.0, odds * (1 - DOUBT / z))))
    ranked.sort()
    names, prior = [f for _, f, _ in ranked], PRIOR * np.array([o for _, _, o in ranked])
    place = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        for batch in batches:
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                swaps = [{"gain": sorted(at[f] for f in gain if f in at), "lose": sorted(at[f] for f in lose if f in at)} for gain, lose in counterfactuals(text)]
                out.append({"y": y, "active": sorted(at[f] for f in _all(words_in(text)) if f in at), "swaps": [s for s in swaps if s["gain"] or s["lose"]]})
            kind = pa.schema([("y", pa.int32()), ("active", pa.list_(pa.int32())), ("swaps", pa.list_(pa.struct([("gain", pa.list_(pa.int32())), ("lose", pa.list_(pa.int32()))])))])
            yield pa.RecordBatch.from_pylist(out, kind)

    got = sample.mapInArrow(rows_of, "y int, active array<int>, swaps array<struct<gain:array<int>,lose:array<int>>>").collect()
    got.sort(key=lambda r: (r.y, r.active))
    y = np.array([float(r.y == 1) for r in got])
    swaps = [(list(s.gain), list(s.lose)) for r in got for s in r.swaps]
    weights, bias = fit([list(r.active) for r in got], y, swaps, prior)
    return Classifier(names, weights, bias)


def scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1, from the whole text alone.

    Null and empty texts have the score of a text without features; very long
    texts are read whole. Repeated rows stay; no rows give no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score
            got = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
