import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture
def make_docs(spark):
    """A documents table of texts, or of (doc_id, text) pairs."""

    def make(rows, extra=(), parts=3, langs=None):
        out = []
        for i, r in enumerate(rows):
            doc_id, text = r if isinstance(r, tuple) else (i, r)
            out.append((doc_id, text, langs[i] if langs else "en", f"src{i % 3}" if i % 4 else None, len(text or "")))
        df = spark.createDataFrame(out, SCHEMA).repartition(parts)
        for c in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
        return df

    return make


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def words(rng):
    """Sentences of invented words."""
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    return text
