from __future__ import annotations

import random

import pytest

from tests.conftest import SF0001

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           "row string, fp long, record string, kept int, block long, hits string, found int, size int, new_text string")


def rows(texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return [(i, t, "en", s, len(t or ""), "r", 1, "x", 0, 2, "h", 3, 4, "n") for i, t, s in zip(ids, texts, sources, strict=True)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        return spark.createDataFrame(rows(texts, ids, sources), COLUMNS)
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF0001}/labels.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty and blank texts, a long text, ties, repeated rows."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    long = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(30000))
    plain = "One line of plain words that says a thing.\nAnd another line with more words to read, said slowly and well."
    return make_docs([None, "", " \n\t ", long, plain, plain, plain, "x", "née Zoë\n\nend"],
                     [1, 2, None, 4, 5, 5, 6, None, 9], ["a", None, "a", "b", "b", "b", None, "c", "c"])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
