import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, in two partitions and with columns that clash with internal names."""
    def make(pairs, **columns):
        rows = [(i, t, "en", "src", None if t is None else len(t), "x", 1) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS + ", cls string, key int").repartition(2)
        return df

    return make


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
