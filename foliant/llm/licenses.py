"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are word bytes once A-Z are lowered: 0-9, a-z and all from 128; all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A-Z lowered, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


# Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices that name or grant a license: label, template, and the phrases that must stand in it.
NOTICES = (
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("mpl", "mozilla public license", ("mozilla public license",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("bsd", "bsd license", ("bsd license",)),
    ("isc", "isc license", ("isc license",)),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    ("cc", "creative commons attribution", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-4", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "without restriction", "sublicense and or sell"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "permission notice appear in all copies"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published"
        " by the free software foundation",
        ("redistribute it and or modify it", "gnu general public license"),
    ),
)

#: Share of a template's words that must stand in their places.
LEAST = 0.75


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]
    base: bool


@dataclass
class Index:
    """Positional postings of the words of all templates' mandatory key phrases, by their rarity.

    ``postings``: word -> its (template, offset) places. ``anchors``: each
    template's (word, offset) places, rarest first. Rarity is the inverse
    frequency of a word over the templates.
    """

    templates: list[Template] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    anchors: list[list[tuple[bytes, int]]] = field(default_factory=list)
    idf: dict[bytes, float] = field(default_factory=dict)

    @classmethod
    def of(cls, base=BASE, notices=NOTICES) -> Index:
        index = cls()
        for phrase, label in base:
            w = words_of(phrase)
            index.templates.append(Template(label, w, [(0, w)], True))
        for label, text, keys in notices:
            w = words_of(text)
            places = []
            for k in map(words_of, keys):
                at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
                places.append((at, k))
            index.templates.append(Template(label, w, places, False))
        n = len(index.templates)
        for t in index.templates:
            for w in set(t.words):
                index.idf[w] = index.idf.get(w, 0) + 1
        index.idf = {w: math.log(1 + n / c) for w, c in index.idf.items()}
        for k, t in enumerate(index.templates):
            places = {(w, at + i) for at, key in t.keys for i, w in enumerate(key)}
            index.anchors.append(sorted(places, key=lambda p: (-index.idf[p[0]], p)))
            for w, i in sorted(places):
                index.postings.setdefault(w, []).append((k, i))
        return index

    def starts(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) where all of a template's mandatory words stand in their relative places.

        The file's licence words are taken by rarity. A word leads to the
        templates whose rarest mandatory word it is; their starts are the
        intersection, word by word from the rarest, of the word's places
        less its offset. A template with a mandatory word that the file
        lacks is left at once.
        """
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                places.setdefault(w, []).append(i)
        out = []
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k in sorted({k for k, _ in self.postings[w] if self.anchors[k][0][0] == w}):
                anchors = self.anchors[k]
                if any(a not in places for a, _ in anchors):
                    continue
                found = {i - anchors[0][1] for i in places[w]}
                for a, offset in anchors[1:]:
                    if not found:
                        break
                    found &= {i - offset for i in places[a]}
                out += [(k, s) for s in found if s >= 0 or not self.templates[k].base]
        return sorted(out)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """(places of base phrases as (start, template), the best match by label).

        A start stands if the key phrases do, and ``LEAST`` of the template's
        words are in their places; around a key phrase the lead may differ.
        A base phrase is its own key phrase.
        """
        base: list[tuple[int, int]] = []
        found: dict[str, float] = {}
        if self.postings.keys().isdisjoint(words):
            return base, found
        for k, start in self.starts(words):
            t = self.templates[k]
            if any(start + at < 0 or words[start + at : start + at + len(key)] != key for at, key in t.keys):
                continue
            if t.base:
                base.append((start, k))
                share = 1.0
            else:
                share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
                if share < LEAST and sum(len(key) for _, key in t.keys) / len(t.words) < LEAST / 1.5:
                    continue
            found[t.label] = max(share, found.get(t.label, 0.0))
        return sorted(base), found


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, starts array<long>"


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """License places and labels (``SCAN``) of every whole text.

    ``starts`` are the word places of all base phrases; score is the best
    match's share of its template's words that stand in their places, 0
    without a match. Null texts count as empty: no words, empty labels, score
    0; very long texts are scanned whole; of matches that tie all give their
    labels. Repeated rows stay; no rows give no rows; other columns are not read.
    """
    index = index or Index.of()
    names = [x.split()[0] for x in SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for data in batch.column(1).cast(pa.binary()):
                words = words_of(data.as_py())
                base, found = index.scan(words)
                own = sorted({index.templates[k].label for _, k in base})
                starts = [s for s, _ in base]
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted(found)), max(found.values(), default=0.0), starts))
            cols = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)
