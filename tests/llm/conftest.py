import pytest
from pyspark.sql import Row
from rolefit.llm.common import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd_texts(llm):
    """Nulls, empty and long texts, repeated rows, ids with two texts, and columns that clash with results."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (1, "another text of the same id"), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, long + " end"),
        (None, "alpha beta gamma delta epsilon zeta"), (None, None), (7, "x" * 30_000), (8, "ünïcode «Text» – naïve ĳ ſ K 😀\r\nline\n\nline"), (9, "line\nline"),
    ]
    schema = "doc_id bigint, text string, ids string, n_lines string, score string, fp string, kept string, key string, o string, body string, n string, word string"
    return llm.createDataFrame([(*r, *["other"] * 10) for r in rows], schema)


@pytest.fixture(scope="session")
def no_texts(llm):
    return llm.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
