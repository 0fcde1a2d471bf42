import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text[, source[, lang]])."""
    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def sample(spark):

    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "One two three"),
        (5, "x " * 40_000), (6, "é́ 　 \U0001f600<|endoftext|> İΣ it's"), (7, "a\n\na\nb\na"),
        (8, "same words " * 30, None, None), (9, "ab" * 3000)]


@pytest.fixture(scope="session")
def edge(docs_of):
    """Nulls in every column, empty and very long texts, repeated rows, and
    extra columns whose names clash with results and helper columns."""
    from pyspark.sql import functions as F
    df = docs_of(EDGE)
    for c in ("size", "kept", "_n", "_sha", "score", "row", "_finish", "class_id", "piece"):
        df = df.withColumn(c, F.lit("x"))
    return df
