import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A maker of document tables from ``(id, text, source)``."""

    def make(rows, extra=()):
        schema = DOCS + "".join(f", `{c}` string" for c in extra)
        return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, *["x"] * len(extra)) for i, t, s in rows], schema)

    return make


@pytest.fixture
def prose():
    def make(seed, n, words=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(words)}" for _ in range(n))

    return make
