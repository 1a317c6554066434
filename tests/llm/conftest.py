import os

import pytest

FOLDER = os.environ.get("INSTQC_DATA", "/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return FOLDER


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, ids used twice, a long text, clashing extra columns."""
    rows = [
        (1, "One two three four five six seven eight nine ten.", "en", "a", 5),
        (1, "One two three four five six seven eight nine ten.", "en", "a", 5),
        (1, "Another text under the same id, with words of its own and more.", "en", "b", 5),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "fr", None, 3),
        (None, "One two three four five six seven eight nine ten.", None, "b", None),
        (None, None, None, None, None),
        (5, "word " * 30_000 + "end.", "de", "a", 1),
        (6, "Ünïcode \U0001f600 текст 文字 without spaces", "es", "c", 2),
    ]
    base = spark.createDataFrame(rows, DOCUMENTS)
    return base.selectExpr("*", "1 AS size", "'x' AS _th", "2 AS shard", "3 AS kept", "4 AS _key", "5 AS _hash", "6 AS _class", "7 AS _row", "8 AS slot", "9 AS _size", "10 AS _id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
