import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(rows, schema=SCHEMA):
        full = []
        for r in rows:
            i, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r[:4]
            full.append((i, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded invented words: prose(n, seed)."""

    def words(n, seed):
        r = random.Random(seed)
        syl = ["an", "re", "on", "the", "in", "er", "ti", "sh", "ou", "ble", "ka", "mo"]
        return [("".join(r.choice(syl) for _ in range(r.randrange(1, 4)))) for _ in range(n)]

    return words


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty texts, a very long text, repeated rows."""
    return make([(1, None), (2, ""), (3, " \t\n"), (None, "some words here that are fine"), (5, "word " * 60_000), (6, "tie"), (6, "tie"), (7, "tie", None, None), (8, "tie\n", "en", "s")])
