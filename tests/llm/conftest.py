import pytest

from pyspark.sql import functions as F

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, numbered from 0, with columns whose names clash with the operators' own."""

    def docs(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, g, None, None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        df = spark.createDataFrame(rows, TEXT).repartition(3)
        return df.withColumns({c: F.lit("clash") for c in ("row", "node", "digest", "t1", "h", "score", "piece", "part", "_text", "band", "held_out")})

    return docs


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, ties, repeats, a very long text."""
    return [None, "", " \n\t ", "a", "a", "A b c d e f", "x" * 50_000, "word " * 20_000, "Ünï çödé ０１ 👍🏽 \x1c\x00z", None]
