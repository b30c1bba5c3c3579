import duckdb
import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from texts; ids from 0, sources in turn. Columns with clashing names stand beside."""

    def make(texts, sources=("a", "b", None), ids=None):
        rows = [(i if ids is None else ids[i], t, "en", sources[i % len(sources)], None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS digest", "text AS size", "lang AS target", "source AS th")

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented prose: n words, some of them new."""

    def make(n, seed, vocabulary=400):
        rng = np.random.default_rng(seed)
        return " ".join(f"w{int(k)}" if k < vocabulary else f"x{seed}q{int(k)}" for k in rng.integers(0, vocabulary * 2, n))

    return make


@pytest.fixture
def duck():
    return duckdb.connect()
