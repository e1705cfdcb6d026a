import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or longer rows, with other columns whose names the operators use inside."""

    def make(rows, n=3):
        rows = [(*r, *([None] * (4 - len(r)))) for r in rows]
        full = [(k, t, lang or "en", source or "s", len(t or ""), 7, "x", 0) for k, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, k long, t string, th long").repartition(n)

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "é😀 中文 text"),
    (6, "same text here"),
    (6, "same text here"),
    (7, "same text here"),
    (8, "x" * 70_000),
    (9, "word " * 30_000),
    (6, "another text under a repeated key"),
    (None, "a text without a key"),
]


@pytest.fixture(scope="session")
def odd():
    """NULLs, blanks, very long texts, ties, repeated rows and keys."""
    return ODD
