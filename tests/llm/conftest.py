import pytest


@pytest.fixture
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties and clashing extra columns."""
    words = "the quick brown fox jumps over a lazy dog while seven wizards quietly judge boxing matches".split()
    long = " ".join(words[k % len(words)] + str(k % 97) for k in range(30_000))
    rows = [
        (1, "the quick brown fox", "en", "a", 0.5), (1, "the quick brown fox", "en", "a", 0.5), (2, None, None, None, None), (3, "", "en", "a", 0.1),
        (None, "the quick brown fox", "de", "b", 0.2), (None, None, None, "b", 0.2), (4, "   \n\t", "en", "a", 0.3), (5, long, "en", "a", 0.4), (6, long, "en", "a", 0.4),
        (7, "é́ \U0001f600 中文 \u0000 x", "fr", "c", 0.4), (8, "one", "en", "a", 0.4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, score double")
