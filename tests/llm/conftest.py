import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text, lang, source) rows."""

    def make(rows, parts=3):
        rows = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows and repeated ids."""
    words = "Der Hund und die Katze laufen über den Hof, the cat and the dog run home.".split()
    long = " ".join(words[(i * i + i // 7) % len(words)] + str(i % 97) for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "de", None), (3, "   \n\t ", None, "b"), (None, "the cat sat on the mat again", "en", "a"),
        (4, "the cat sat on the mat again", "en", "a"), (4, "the cat sat on the mat again", "en", "a"), (5, long, "de", "c"), (6, "x", "fr", "c"),
        (7, "日本語 テキスト 🙂 naïve <|endoftext|> 'Tis fine\x1cyes don't", "es", "c"), (8, "\x00 odd \x1f bytes   and    runs of space ", None, None), (4, "another text under the id of row four", "en", "b"),
    ]
    return make_docs(rows)
