import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like rows from texts, with extra columns whose names the operators use inside."""

    def make(texts, ids=None):
        rows = [(i, t, None, "s", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("row", F.lit("r")).withColumn("keep", F.lit(0)).withColumn("score", F.lit("z"))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
