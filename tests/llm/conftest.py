import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts or ``(doc_id, text)`` pairs."""

    def make(*rows):
        pairs = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def awkward(spark):
    """Rows with nulls, empty and very long texts, ties and repeats, and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 997} and" for i in range(60_000))
    rows = [
        (None, None, None, None, None, 1, "x", 0.5),
        (1, None, "en", "a", 0, 2, "x", None),
        (2, "", "en", None, 0, 3, None, 0.1),
        (3, " \n\t ", None, "a", 4, 4, "y", 0.2),
        (None, "some words that stand alone here", "en", "a", 32, 5, "y", 0.3),
        (4, long_text, "en", "a", len(long_text), 6, "z", 0.4),
        (5, "same text in rows of different ids", "en", "b", 34, 7, "z", 0.4),
        (6, "same text in rows of different ids", "en", "b", 34, 8, "z", 0.4),
        (6, "same text in rows of different ids", "en", "b", 34, 8, "z", 0.4),
        (7, "éèê   ünïcödé \U0001f600 text", "fr", "b", 20, 9, "z", 0.4),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score int, shard string, kept double"
    )


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
