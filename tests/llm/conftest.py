import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, y int, key string"


def words(seed, n, size=8):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, size))) for _ in range(n)]


def doc_rows(texts):
    """Rows of documents with extra columns whose names operators use inside."""
    return [(k, t, None, ["b", None, "a", "c"][(k or 0) % 4], None if t is None else len(t), 7, 0.5, 3, "x") for k, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, start=0):
        texts = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts, start))
        return spark.createDataFrame(doc_rows(texts), DOCS)

    return make


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
