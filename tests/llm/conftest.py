import pytest

ROWS = [
    (1, "Plain words of a text, plain words of a text.", "en", "a", 44),
    (2, None, None, None, None),
    (3, "", "", "", 0),
    (1, "Plain words of a text, plain words of a text.", "en", "a", 44),
    (None, "No id here but 日本語 and 🎉 it has words\n\n  <|endoftext|>end don't", "xx", "b", 1),
    (4, " \t\n ", "en", "b", 4),
    (5, "long " * 5_000 + "x" * 3_000, "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those the operators make."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    clashing = ("ids", "n_tokens", "score", "kept", "node", "h", "at", "kind", "normal", "weight", "epoch")
    return df.selectExpr("*", *(f"'x' as {c}" for c in clashing))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
