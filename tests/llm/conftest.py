import random

import pytest

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (id, text) pairs; columns that operators use inside clash on purpose."""

    def make(rows, extra="score double, row int, part int, found string, n_tokens string"):
        schema = DOCUMENT + (", " + extra if extra else "")
        width = len(extra.split(",")) if extra else 0
        full = [(i, t, "en", "src", None if t is None else len(t), *[None] * width) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts over a small vocabulary, by seed."""

    def make(seed, words=120):
        rng = random.Random(seed)
        vocabulary = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "po") for b in ("", "ra", "se", "ti", "vu")]
        return " ".join(rng.choice(vocabulary) for _ in range(words))

    return make


EDGES = [(1, None), (2, ""), (3, "   \n\t"), (None, "some text without an id"), (5, "word " * 60_000), (6, "one"), (6, "one")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
