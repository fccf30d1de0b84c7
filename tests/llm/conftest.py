import pytest
from odd import CLASHES, SCHEMA, odd_rows
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and columns whose names clash with inner ones."""
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
