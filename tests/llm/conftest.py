import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, host string, n int, block string, Part string, w0 string"
WORDS = [a + b + c for a in "ba ce di fo gu ha ji ko lu me".split() for b in "na re ti so mu".split() for c in ("", "ld", "rst", "ment")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents from (id, text) or (id, text, lang, source) rows, with columns whose names operators might use."""

    def make(rows):
        full = []
        for r in rows:
            i, t, lang, source = (*r, "en", "s")[:4] if len(r) == 2 else r
            full.append((i, t, lang, source, None if t is None else len(t), "x", None, 7, "b", "p", "w"))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty, blank and very long texts, repeated rows, ties."""
    long = prose(random.Random(5), 60_000)
    return docs([(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, None), (4, "one", "en", None), (4, "one", "en", None), (None, "lost words here", "en", "s"), (5, "!!! ... ???", "fr", "s"), (6, long, "en", "s"), (7, "one", None, "s"), (8, "x" * 50_000, "en", "s")])
