import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", "s.example.com", len(t or ""), 1, 2, "x", 3) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA + ", row long, block long, key string, n long")

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [(1, "a b c d e f g h"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (7, long), (7, long), (None, "a b c d e f g h"), (8, "é"), (9, "x")]
