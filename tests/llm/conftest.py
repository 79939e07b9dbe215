import pytest

WORDS = "the river runs under an old stone bridge where two quiet boats wait for morning light and early trade".split()


def sentence(n: int, shift: int = 0) -> str:
    return " ".join(f"{WORDS[(i * 7 + shift) % len(WORDS)]}{(i * i + shift) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, clashing column names."""
    long_text = sentence(6000, 3)
    rows = [
        (0, sentence(60), "en", "src1", 1, 9, 9),
        (1, sentence(60), "de", "src2", 1, 9, 9),
        (2, None, None, None, None, None, None),
        (3, "", "en", "src1", 0, 9, 9),
        (4, " \n\t ", "en", "src1", 3, 9, 9),
        (5, "...!!!", "fr", "src3", 6, 9, 9),
        (6, long_text, "en", "src0", len(long_text), 9, 9),
        (7, "x" * 70_000, "en", "src0", 70_000, 9, 9),
        (8, sentence(60) + " tail", "en", "src0", 1, 9, 9),
        (9, "two words", "en", "src0", 9, 9, 9),
        (9, "two words", "en", "src0", 9, 9, 9),
        (10, "Two WORDS", "es", "src0", 9, 9, 9),
        (11, "élan naïve façade ß", "fr", "src5", 5, 9, 9),
        (None, "no id here at all today", "en", "src4", 5, 9, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, tokens long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
