import pytest

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                    # extra columns that clash with names the operators use inside
                    T.StructField("size", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("score", T.DoubleType()),
                    T.StructField("pos", T.StringType()), T.StructField("n", T.StringType()), T.StructField("seg", T.StringType())])

PROSE = [f"w{(i * i * 7 + i * 13) % 97} {chr(97 + i % 26)}{i % 31}" for i in range(900)]


def prose(a, b):
    return " ".join(PROSE[a:b])


def doc(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), "x", 1, 0.5, None, None, None)


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies."""
    base = prose(0, 120)
    return [
        doc(1, base), doc(2, base), doc(2, base), doc(3, base + " tail"), doc(4, prose(200, 330), "de", None),
        doc(5, None, None), doc(6, ""), doc(7, " \t\n "), doc(8, "One two", "fr"), doc(9, "one  TWO", "fr"),
        doc(None, prose(40, 160), None, None), doc(10, prose(300, 420) + " ünï 日本 " + prose(0, 60), "de", "s1"),
        doc(11, prose(0, 900) * 6, "en", "s1"), doc(12, "x"), doc(12, "another text under the same id"), doc(13, "!!! ??? 123", None),
        doc(-4, prose(500, 620).upper()), doc(14, "a.\nb  c\r\n　d <|endoftext|> it's"), doc(15, prose(300, 420), "de", "s1"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
