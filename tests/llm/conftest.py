import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]); columns with names that operators use themselves are added on demand."""
    from pyspark.sql import functions as F

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("id", "key", "fp", "spans", "start", "n_words", "item", "host", "line", "part", "_key", "_gone", "_spans", "rest"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return make
