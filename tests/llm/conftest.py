import pytest
from llm_texts import prose


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with names that clash."""
    rows = [
        (1, prose(1, 120), "en", "a"),
        (1, prose(1, 120), "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "fr", "b"),
        (None, prose(2, 80), "en", "b"),
        (None, None, None, None),
        (5, prose(3, 60_000), "en", "a"),
        (6, "ÀÉ\U0001f600 ßz" * 40, "fr", "b"),
        (7, prose(1, 120), "en", "c"),
        (8, "one two", "en", "c"),
    ]
    more = [(*r, len(r[1]) if r[1] is not None else None, 1, "x", 2, "y", 3, 4, "z", 5, "g", 6) for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, place long, class string, block int, blob string, kept int, component_id long, spans string, b int, g string, s int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
