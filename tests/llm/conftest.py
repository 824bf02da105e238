import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Nulls, blanks, ties, repeated rows, odd characters and a long text.
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog today.\nA second line that is long enough to count.", "a"),
    (2, None, "a"),
    (3, "", "b"),
    (4, " \t\n\r\x0b\x0c ", "b"),
    (5, "word " * 3000 + "end", "c"),
    (6, "A second line that is long enough to count.\nshort\n  A SECOND line that is long enough to count. ", "c"),
    (7, "A second line that is long enough to count.", None),
    (7, "A second line that is long enough to count.", None),
    (None, "a second line that is long enough to count.", "d"),
    (9, "ÄÖÜ straße ÉCOLE x̸ 日本語 İstanbul ΣΑΣ <|endoftext|> it's 12a3b", "e"),
    (10, "The quick brown fox jumps over the lazy dog today.\nA second line that is long enough to count.", "a"),
    (-3, "one", "z"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases, with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, s, -1, "x", 0.5, "h", 7) for i, t, s in EDGE],
        "doc_id long, text string, source string, fp long, id string, score double, hash string, bucket int")


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
