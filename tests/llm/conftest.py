import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts (ids 0..), with columns whose names clash with the operators' own."""

    def make(texts, langs=None, extra=True):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("key", "score", "n", "region", "ids", "start", "rank", "_h", "label"):
                df = df.withColumn(c, F.lit(1))
        return df

    return make
