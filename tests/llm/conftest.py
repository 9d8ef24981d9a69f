import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) tuples, with columns whose names clash with those of results."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), 7, "x") for r in rows]
        schema = T.StructType.fromDDL(DOCS + ", n_words int, spans string")
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


EDGE = [
    (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (4, "   \n\t "), (None, "alpha beta"), (None, None), (5, "é" * 50), (6, "word " * 3000), (7, "a\x00b \x0b\x0c c"), (8, "漢字 かな 🙂 Σίσυφος"), (9, "x" * 70_000),
]
