import random

import pytest
from invented import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fingerprint int, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, null and repeated ids, columns whose names clash."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [
        (1, base, "aa", "s", 1, "x", 7, "no"),
        (2, base, "aa", "s", 1, "x", 7, "no"),
        (2, base, "aa", "s", 1, "x", 7, "no"),
        (3, base.replace("the", "those", 1), None, None, None, None, None, None),
        (4, "", "aa", "s", 0, "", 0, ""),
        (5, None, "bb", "s", None, None, None, None),
        (None, prose(rng, 60), "bb", "s", 5, None, None, None),
        (None, None, None, None, None, None, None, None),
        (6, "   \n\t ", "bb", "s", 3, None, None, None),
        (7, prose(rng, 30_000), "bb", "s", 9, None, None, None),
        (8, "x" * 200_000, "aa", "s", 9, None, None, None),
        (9, "ÀÉ ñandú 日本語 🙂 it's <|endoftext|> 12 3a", "aa", "s", 9, None, None, None),
        (10, "word " * 50, "aa", "s", 9, None, None, None),
    ]
    return spark.createDataFrame(rows + [(100 + i, prose(rng, rng.randint(5, 80)), "aa" if i % 2 else "bb", "s", 1, None, None, None) for i in range(60)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 1, 1), (None, 1, 0), (3, None, None), (4, 0, None)] + [(100 + i, 1 if i % 3 else 0, 0) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
