import random

import pytest


@pytest.fixture
def docs(spark):
    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        names = ["doc_id", "text", *more]
        schema = "doc_id long, text string" + "".join(f", `{c}` string" for c in more)
        return spark.createDataFrame([tuple(r) for r in zip(ids, texts, *more.values(), strict=True)], schema) if ids else spark.createDataFrame([], schema)

    return make


@pytest.fixture
def prose():
    """Invented sentences: (n words, seed) to text."""

    def make(n, seed=0):
        rng, out, at = random.Random(seed), [], 0
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "ti", "hi", "as", "te", "et", "ng", "of", "al", "de", "se", "le"]
        while at < n:
            k = min(n - at, rng.randint(6, 14))
            words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(k)]
            out.append(" ".join(words).capitalize() + ".")
            at += k
        return " ".join(out)

    return make


@pytest.fixture
def odd_texts(prose):
    """Null, empty, blank, tiny, repeated, very long and strange texts."""
    return [None, "", "   \n\t ", "x", "one two three", prose(40, 1), prose(40, 1), prose(40, 1), "a " * 50_000, "x" * 200_000, "\u0000\ud7ff é\u00a0ß ’ 漢字 \U0001f600 <|endoftext|>", "\r\n\r\n", prose(3000, 2)]
