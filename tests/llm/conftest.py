import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """Documents from texts; ids count up unless given, and sources alternate."""

    def make(texts, ids=None, sources=None):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        sources = [f"s{i % 3}" for i in range(n)] if sources is None else sources
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)

    return make
