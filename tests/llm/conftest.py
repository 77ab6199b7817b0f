import pytest
from llm_rows import BODY, PASSAGE

COLUMNS = (
    "doc_id long, text string, lang string, row string, h string, id string, n_words string, score string, value string,"
    " block string, key string, set string, node string, component string, label string, host string, path string, at string"
)
@pytest.fixture(scope="session")
def odd_rows():
    """Ids and texts: nulls, empty and very long texts, repeated rows, ties, odd characters."""
    return [
        (1, BODY),
        (2, BODY),
        (2, BODY),
        (3, BODY.replace("wort7 ", "other ")),
        (4, None),
        (5, ""),
        (6, "  \n\t "),
        (None, "a text without an id " + PASSAGE),
        (None, None),
        (None, BODY),
        (7, PASSAGE.upper() + "!"),
        (8, "one line\none line\n\none line\r\n" + PASSAGE),
        (9, "ab " * 40000 + PASSAGE),
        (10, "x" * 70000),
        (11, "\0\0 nul \0\x85 next\u2028line 🎉🎉 ÉÀß"),
        (12, "short"),
        (12, "another text of the same id " + BODY[:300]),
        (13, "Licensed under the Apache License, Version 2.0. " + BODY[200:500]),
        (-3, PASSAGE + " " + BODY[100:700]),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names the operators use themselves."""
    extra = ["x"] * 16
    return spark.createDataFrame([(i, t, *extra) for i, t in odd_rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
