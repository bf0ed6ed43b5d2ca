import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs; more columns with clashing names on request."""
    def make(items, extra=False):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
        if extra:
            for c in ("words", "fp", "a", "b", "key", "root", "pos", "h1", "kept", "spans", "doc_key", "score", "text2"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
