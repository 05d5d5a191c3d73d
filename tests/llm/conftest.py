import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, tied, repeated and long texts, with clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n"), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (6, "é" * 500), (7, long), (8, long + " end"), (9, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for extra in ("score", "id", "fp", "block", "ids", "label", "TEXT"):
        df = df.withColumn(f"_{extra}", F.lit(1))
    return df.toDF("doc_id", "text", "score", "id", "fp", "block", "ids", "label", "TEXT")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
