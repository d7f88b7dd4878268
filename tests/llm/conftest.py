import pytest

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def documents(spark):
    """Documents from texts: ids from 0 in order, other columns filled in."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, text, lang, "src0", None if text is None else len(text)) for i, text, lang in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture
def odd_documents(documents):
    """Null ids, texts and languages, empty and blank texts, repeated rows, a long text, more columns than needed."""
    from pyspark.sql import functions as F

    texts = [None, "", " \n\t ", "plain words here", "plain words here", "Straße und ÜBER allem ▁ 漢字 😀", "word " * 40_000, "no id"]
    ids = [0, 1, 2, 3, 3, 5, 6, None]
    made = documents(texts, ids, ["en", "en", None, "en", "en", "de", "en", "en"])
    clash = ["spans", "ids", "f0", "shingles", "component", "component_id", "score", "n_tokens", "node", "row", "h", "low", "words", "label", "_id", "id"]
    return made.select("*", *(F.lit("x").alias(name) for name in clash))


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
