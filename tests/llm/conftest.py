import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("size", "key", "norm", "fp", "bucket", "taken", "sha", "word", "doc", "__id")],
])


def frame(spark, rows):
    """Documents with extra columns whose names clash with helper columns. rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        d, text, lang, source = (*r, *["en", "src0"][len(r) - 2 :]) if len(r) < 4 else r
        full.append((d, text, lang, source, None if text is None else len(text), *["x"] * 10))
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    words = "the of and to in a house garden river mountain letter paper window table chair bread water stone light night".split()
    return " ".join(r.choice(words) + r.choice(["", "", "", ".", ","]) for _ in range(n))


NASTY = [
    (1, None, None, None), (2, "", "en", None), (3, " \t\n ", "de", "b"), (4, "One two three", "en", "a"), (5, "One  two\nthree", "en", "a"),
    (6, prose(1, 300), "en", "a"), (6, prose(1, 300), "en", "a"), (7, prose(1, 300), "fr", "c"), (8, prose(1, 299) + " end", None, "a"), (9, "é" * 50, "fr", "b"),
    (10, prose(2, 40_000), "en", "a"), (11, "a" * 3000, "en", "c"), (None, prose(3, 50), "es", "b"), (None, None, None, None), (12, "x", "en", "a"), (12, "y", "en", "b"), (-5, "\U0001f600 <|endoftext|> ok", "en", "a"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    return frame(spark, NASTY)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
