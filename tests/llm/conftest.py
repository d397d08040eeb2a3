import pytest
from text_rows import ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, name long, idx int, words string, _salt long"

@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "k", 1, 2, "w", 3) for i, t, g, s in ROWS], SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
