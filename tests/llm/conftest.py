import pytest

ROW = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id string, _row string, rank string"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, ("en", "fr", None)[i % 3], (None, "src1", "src2")[i % 3], None, 0.5, None, "x", "y", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, ROW)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [None, "", " \t\n", "one", "the same words again", "the same words again", "Ünïcödé wörds ßtraße naïve", "x" * 50_000, "word " * 30_000, "a.b,c;d\r\ne\x0bf\x0cg", "😀 👩‍👩‍👧 emoji"]
