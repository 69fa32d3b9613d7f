import pytest


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with other columns and one whose name an operator might use."""

    def make(rows, source="s"):
        data = [(i, t, "en", source if isinstance(source, str) or source is None else source[k % len(source)], len(t or ""), "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)

    return make
