import hashlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, bucket long"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names operators use inside."""
    line = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly slowly towards the evening sun again.\n"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (4, line * 3, "en", "a", 9), (5, line * 3, "en", "b", 9), (5, line * 3, "en", "b", 9),
        (6, "x" * 200_000, "en", "a", 1), (7, "ab " * 40_000, "en", "a", 1), (None, line, "en", "c", 1), (None, None, None, None, None), (8, "token = \"abcdefgh12345678\" <|endoftext|> ünïcödé 日本 ½", "de", "a", 1),
        (-9, line + "Completely different words follow here, written by nobody in particular.", "en", "a", 1), (10, "one two", "en", "a", 1), (11, "one  two", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, "k", 7) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
