import pytest


@pytest.fixture
def docs(spark):
    """Rows with a null id, null and empty texts, copies, repeated rows and columns of clashing names."""

    def make(*texts):
        rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "own", "own", "own", "own") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, items string, digest string, ids string")

    return make
