import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

# Nulls, empty, blank, symbols, non-ASCII, copies, repeated rows and ids, a very long text.
SAMPLE = [
    (1, "the cat sat on the mat and looked at the small bird outside of the window."),
    (2, "the cat sat on the mat and looked at the small bird outside of the window."),
    (3, "THE CAT sat\ton the mat  and looked at the small bird outside of the window."),
    (4, None), (5, ""), (6, " \n\t "), (7, "word"), (8, "two words"), (9, "a b c d e a b c d e a b c d e"),
    (10, "Über den Dächern 中文 字 naïve é́ 😀 | nav | bar\n\nline one.\nline one.\n#tag $5 50% a&b <b> *"),
    (11, "x" * 3000 + " " + "long words here " * 4000), (12, "the cat sat on the mat and looked at the small bird outside of the window."),
    (12, "the cat sat on the mat and looked at the small bird outside of the window."), (None, "a row without an id but with text"), (None, None),
    (15, "ends with a nul \x00 and a mark ▁ and <|endoftext|> inside  text \x85 \x1c end "),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in SAMPLE], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
