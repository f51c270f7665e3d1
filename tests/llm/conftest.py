import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, block int, shard int, target double, items string, w string, label string"


def word(rng, letters="aeioubcdlmnrst"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows(pairs):
    """Documents of (doc_id, text) whose other columns carry names that operators use themselves."""
    return [(i, t, "en" if i is not None else None, None if i is None else f"s{i % 3}", None, 7, 0.5, 1, 2, 3, 4.0, "x", "y", "z") for i, t in pairs]


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, one-word, repeated and very long texts, a null id, and clashing names."""
    rng = random.Random(1)
    long = prose(rng, 60_000)
    same = prose(rng, 40)
    pairs = [(1, ""), (2, None), (3, " \n\t "), (4, "word"), (4, "word"), (5, same), (6, same), (7, same + " extra"), (None, same), (8, long), (9, "Ünï çödé 漢字 text"), (10, "1 2 3 !!!")]
    return spark.createDataFrame(rows(pairs), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Three hundred documents with exact copies, near copies and one hot source."""
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(200)]
    for k in range(60):
        base = texts[k % 7].split()
        if k % 2 and len(base) > 3:
            base[rng.randrange(len(base))] = word(rng)
        texts.append(" ".join(base))
    texts += [texts[0]] * 40
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    return spark.createDataFrame(rows(pairs), SCHEMA).repartition(4)
