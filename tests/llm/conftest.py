import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, tag string, _text string, n string, rate string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) with extra columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", None, None if t is None else len(t), None, "x", "y", "z") for i, t in rows], WIDE)
    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(None, None), (None, "a b"), (1, ""), (1, ""), (2, "same words here"), (3, "same words here"),
            (4, long), (5, long + " tail"), (4, "other text"), (6, " \n\t "), (7, "é" * 50_000)]
    return documents(rows)
