"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.shared import trim

ORDER = 5
SPACE = 32
#: Multiplier of the rolling hash and of the character mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
POWERS = np.array([pow(int(BASE), k, 1 << 64) for k in range(ORDER)], np.uint64)
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mix(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    x ^= x >> np.uint64(32)
    return x * MIX


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, counts): lower-cased letters with single spaces between, each text behind ORDER - 1 spaces.

    ``places`` are where the texts' own characters stand, ``counts`` how many
    each text has.
    """
    low = [t.lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
    if len(before):
        before[starts[lens > 0]] = False
    keep = letter | before
    doc = np.repeat(np.arange(len(low)), lens)[keep]
    counts = np.bincount(doc, minlength=len(low))
    places = np.arange(len(doc)) + (ORDER - 1) * (doc + 1)
    out = np.full(len(doc) + (ORDER - 1) * len(low), SPACE, np.uint32)
    out[places] = np.where(letter, codes, SPACE)[keep]
    return out, places, counts


def _rolled(codes: np.ndarray) -> list[np.ndarray]:
    """For each order from 1: the hash of the n-gram that ends at each place."""
    one = _mix(codes)
    out = [one]
    for n in range(1, ORDER):
        h = out[-1].copy()
        h[n:] += one[:-n] * POWERS[n]
        out.append(h)
    return out


class HashArray:
    """Sorted hashes, found through the first bits' start places."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash."""
        at = self.start[(h >> self.shift).astype(np.int64)]
        got = self.keys[at]
        less = np.flatnonzero(got < h)
        while len(less):
            at[less] += 1
            got[less] = now = self.keys[at[less]]
            less = less[now < h[less]]
        found = got == h
        found &= at < len(self.keys) - 1
        return at, found


#: Languages whose tables stand side by side.
BESIDE = 32


class Tables:
    """Log probabilities of some languages side by side, for each order's n-grams that any of them has."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], letters: int):
        """grams: for each language the code points (n x ORDER) of its distinct n-grams; counts: how often; letters: of all languages."""
        n_langs = len(grams)
        every = np.concatenate(grams)
        owner = np.concatenate([np.full(len(g), k) for k, g in enumerate(grams)])
        weight = np.concatenate(counts).astype(np.float64)
        levels = []  # from the longest: unique grams, their counts by language
        for n in range(ORDER, 0, -1):
            tail = every[:, ORDER - n :]
            h = self._hash(tail)
            keys, first, place = np.unique(h, return_index=True, return_inverse=True)
            table = np.zeros((len(keys), n_langs))
            np.add.at(table, (place, owner), weight)
            levels.append((keys, tail[first], table))
            # continuation counts: each distinct longer gram counts once
            pair = np.unique(place.astype(np.int64) * n_langs + owner, return_index=True)[1]
            every, owner, weight = every[pair], owner[pair], np.ones(len(pair))
        self.floor = np.full(n_langs, -np.log(letters + 1.0))
        lower = np.full((1, n_langs), 1.0 / (letters + 1))
        lower_keys = None
        self.grams, self.logp, self.contexts, self.back = [], [], [], []
        for n, (keys, chars, table) in enumerate(reversed(levels), 1):
            ctx_keys, ctx = np.unique(self._hash(chars[:, :-1]), return_inverse=True)
            below = np.zeros(len(keys), np.int64) if n == 1 else np.searchsorted(lower_keys, self._hash(chars[:, 1:]))
            total, kinds = np.zeros((len(ctx_keys), n_langs)), np.zeros((len(ctx_keys), n_langs))
            np.add.at(total, ctx, table)
            np.add.at(kinds, ctx, table > 0)
            once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(1.0, once + 2.0 * twice), 0.5)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.where(total[ctx] > 0, np.maximum(table - discount, 0) / np.maximum(total[ctx], 1), 0) + rest[ctx] * lower[below]
            self.grams.append(HashArray(keys))
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(HashArray(ctx_keys))
            self.back.append(np.log(rest).astype(np.float32))
            lower, lower_keys = p, keys

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h, n = np.zeros(len(chars), np.uint64), chars.shape[1]
        for k in range(n):
            h += _mix(chars[:, n - 1 - k]) * POWERS[k]
        return h

    def nats(self, hashes: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at ``places``, by language."""
        out = np.zeros((len(places), len(self.floor)), np.float32)
        rows, at = np.arange(len(places)), places
        for n in range(ORDER, 0, -1):
            where, found = self.grams[n - 1].find(hashes[n - 1][at])
            out[rows[found]] += self.logp[n - 1][where[found]]
            rows, at = rows[~found], at[~found]
            if not len(rows):
                break
            context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            where, found = self.contexts[n - 1].find(context)
            out[rows[found]] += self.back[n - 1][where[found]]
        else:
            out[rows] += self.floor.astype(np.float32)
        return out


class Model:
    """The languages' tables, ``BESIDE`` of them side by side, with rejection bounds; any number of languages."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        """For each language its n-grams and counts, as ``Tables`` takes them."""
        self.langs, n_langs = langs, len(langs)
        self.mean, self.spread, self.noise, self.heat = np.zeros(n_langs), np.full(n_langs, np.inf), np.zeros(n_langs), 1.0
        letters = max(1, len(np.unique(np.concatenate([g[:, -1] for g in grams])))) if grams else 1
        self.tables = [Tables(grams[k : k + BESIDE], counts[k : k + BESIDE], letters) for k in range(0, n_langs, BESIDE)]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character by text and language, characters by text)."""
        codes, places, counts = characters(texts)
        hashes = _rolled(codes)
        sums = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(counts)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
            for k, t in enumerate(self.tables):
                sums[full, k * BESIDE : k * BESIDE + len(t.floor)] = np.add.reduceat(t.nats(hashes, places), starts, axis=0, dtype=np.float64)
        return -sums / np.maximum(counts, 1)[:, None], counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float, int]]:
        """(language, score, rejected, nats a character, characters) of each text."""
        out = []
        group, size = [], 0
        for k, t in enumerate(texts):
            group.append(t or "")
            size += len(group[-1])
            if size > 400_000 or k == len(texts) - 1:
                out += self._predict(group)
                group, size = [], 0
        return out

    def _predict(self, texts: list[str]) -> list[tuple[str, float, bool, float, int]]:
        if not self.langs:
            return [(UNKNOWN, 0.0, True, 0.0, 0)] * len(texts)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        least = h[np.arange(len(h)), best]
        share = np.exp(-(h - least[:, None]) * n[:, None] / self.heat)
        score = 1 / share.sum(axis=1)
        bound = self.mean[best] + self.spread[best] + self.noise[best] / np.sqrt(np.maximum(n, 1))
        return [
            (UNKNOWN, 0.0, True, 0.0, 0) if not m else (self.langs[b], float(s), bool(e > lim), float(e), int(m))
            for b, s, e, lim, m in zip(best.tolist(), score.tolist(), least.tolist(), bound.tolist(), n.tolist())
        ]

    def calibrate(self, truth: list[str], texts_h: np.ndarray, n: np.ndarray, widths: float = 8.0) -> None:
        """Sets the rejection bounds and the heat of the scores from labelled texts that weren't counted.

        A language rejects above its mean entropy plus ``widths`` standard
        deviations: one of long texts, one that falls with the square root of
        the length. The heat is the one of a fixed ladder with the best
        log-likelihood.
        """
        place = {x: k for k, x in enumerate(self.langs)}
        y = np.array([place.get(t, -1) for t in truth])
        ok = (y >= 0) & (n > 0)
        y, h, n = y[ok], texts_h[ok], n[ok]
        if not len(y):
            return
        own = h[np.arange(len(y)), y]
        for k in range(len(self.langs)):
            mine, m = own[y == k], n[y == k]
            if len(mine) < 8:
                mine, m = own, n
            self.mean[k] = np.average(mine, weights=np.sqrt(m))
            off = mine - self.mean[k]
            long = m >= np.median(m)
            self.spread[k] = widths * max(float(np.sqrt(np.mean(off[long] ** 2))), 0.02)
            self.noise[k] = widths * max(float(np.sqrt(np.mean(off**2 * m))), 1.0)
        best = -np.inf
        for heat in 2.0 ** np.arange(0, 9):
            z = -h * n[:, None] / heat
            z -= z.max(axis=1, keepdims=True)
            fit = float(np.mean(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))))
            if fit > best + 1e-9:
                best, self.heat = fit, float(heat)


def _texts(batch: pa.RecordBatch, at: int) -> list[str | None]:
    return batch.column(at).to_pylist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each batch and language, packed into two longs, with their counts."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), _texts(batch, 1)
        for lang in sorted(set(langs)):
            mine = [t for k, t in zip(langs, texts) if k == lang and t]
            for s in range(0, len(mine), 256):
                codes, places, _ = characters(mine[s : s + 256])
                if not len(places):
                    continue
                _, first, n = np.unique(_rolled(codes)[ORDER - 1][places], return_index=True, return_counts=True)
                ends = places[first]
                c = [codes[ends - k].astype(np.int64) for k in range(ORDER - 1, -1, -1)]
                high, low = (c[0] << 21) | c[1], (c[2] << 42) | (c[3] << 21) | c[4]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(high), pa.array(low), pa.array(n.astype(np.int64))], ["lang", "high", "low", "n"])


def train(docs: DataFrame, held_out: int | None = 5, docs_per_language: int = 2000, calibration_share: float = 0.1) -> Model:
    """A model of every language of ``docs`` (doc_id, text, lang).

    Learned from a sample of about ``docs_per_language`` labelled documents of
    each language (the stated bound of the fit), chosen by a hash of the
    doc_id; where ``held_out`` is set, documents whose crc32(doc_id) is a
    multiple of it are left out. ``calibration_share`` of the sample is kept
    for the bounds and the score's heat. N-grams are counted on the
    executors; only their sums by language come to the driver. Null langs and
    null texts are left out; no rows, or none labelled, give a model without
    languages.
    """
    spark = docs.sparkSession
    rows = docs.where("lang is not null")
    if held_out:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out != 0)
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Model([], [], [])
    shares = spark.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["count"])) for r in counts], "__lang string, __share double")
    lot = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where(lot < F.col("__share")).select("lang", F.col("text").cast("string").alias("text"), (lot / F.col("__share")).alias("lot"))
    counted = sample.where(F.col("lot") >= calibration_share).select("lang", "text").mapInArrow(_counted, "lang string, high long, low long, n long")
    table = counted.groupBy("lang", "high", "low").agg(F.sum("n").alias("n")).toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    known = coded.dictionary.to_pylist()
    place = np.empty(len(known), np.int64)
    place[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
    names = place[coded.indices.to_numpy()] if known else np.zeros(0, np.int64)
    high, low, n = (table.column(c).to_numpy() for c in ("high", "low", "n"))
    mask = (1 << 21) - 1
    chars = np.stack([high >> 21, high & mask, low >> 42, (low >> 21) & mask, low & mask], axis=1).astype(np.uint32) if len(n) else np.zeros((0, ORDER), np.uint32)
    langs = sorted(known)
    order = np.lexsort((low, high)) if len(n) else np.zeros(0, int)
    names, chars, n = names[order], chars[order], n[order]
    model = Model(langs, [chars[names == k] for k in range(len(langs))], [n[names == k] for k in range(len(langs))])
    del table, high, low, chars, n, names
    trim()
    if langs:
        shared = spark.sparkContext.broadcast(model)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = _texts(batch, 1)
                for s in range(0, len(texts), 64):
                    h, m = shared.value.entropies([t or "" for t in texts[s : s + 64]])
                    yield pa.RecordBatch.from_arrays([batch.column(0)[s : s + 64], pa.array(list(h), pa.list_(pa.float64())), pa.array(m.astype(np.int64))], ["lang", "h", "m"])

        held = sample.where(F.col("lot") < calibration_share).select("lang", "text").mapInArrow(measured, "lang string, h array<double>, m long").collect()
        held.sort(key=lambda r: (r["lang"], r["m"], r["h"]))
        if held:
            model.calibrate([r["lang"] for r in held], np.array([r["h"] for r in held]), np.array([r["m"] for r in held]))
    return model


#: What ``identify`` adds, with the Arrow types.
PREDICTION = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "rejected": ("boolean", pa.bool_()), "entropy": ("double", pa.float64()), "letters": ("long", pa.int64())}


def identify(docs: DataFrame, model: Model, keep: list[str], prefix: str = "") -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``PREDICTION``, its names behind ``prefix``, for every text.

    Null texts and texts without letters are ``und`` with score 0, rejected.
    ``rejected`` also marks texts whose entropy is beyond what the best
    language's own texts of that length have. Very long texts are scored
    whole; of languages that tie the first by name is told. Only the text is
    read.
    Repeated rows stay; no rows give no rows; a kept column may not have the
    name of an added one.
    """
    added = [prefix + name for name in PREDICTION]
    if clash := set(added) & set(keep):
        raise ValueError(f"columns {sorted(clash)} are added here; give a prefix")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)
    n_keep, types, names = len(keep), [t for _, t in PREDICTION.values()], [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*shared.value.predict(_texts(batch, at)))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *[pa.array(g, t) for g, t in zip(got, types)]], names)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{a}` {t}" for a, (t, _) in zip(added, PREDICTION.values())])
    more = [] if "text" in keep else [F.col("text").cast("string").alias("__text")]
    return docs.select(*keep, *more).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns, one pass."""
    cols = docs.columns
    return identify(docs, model, cols, "__lang_").where(~F.col("__lang_rejected")).select(*cols)
