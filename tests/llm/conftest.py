import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WHITE_DELETED = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def long_text(words: int = 3000) -> str:
    return " ".join(f"w{i % 977}x{i}" for i in range(words))


AWKWARD = [
    (1, "the same text of some words\nand a line", "en", "a", 38),
    (1, "the same text of some words\nand a line", "en", "a", 38),  # repeated row
    (2, "the same  text of some words and\ta line", None, "a", None),  # equal but for white space
    (3, None, "en", None, None),
    (4, "", "de", "b", 0),
    (5, " \n\t ", "fr", "b", 4),
    (None, "a text without an id of some words", "en", "b", 34),
    (7, long_text(), "en", "b", 1),
    (8, "ÄÖÜ ß 日本語 😀 ", None, None, 13),
    (9, "123 456 !!", "en", "a", 10),
]


@pytest.fixture(scope="session")
def sample():
    """doc_id, text of a given table."""
    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns named like outputs."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS)
    for c in ("n_tokens", "kept", "score", "component_id", "spans", "n_words", "sid", "digest", "row", "grp", "n_lines", "ids", "key", "size"):
        df = df.withColumn(c, F.lit("other"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
