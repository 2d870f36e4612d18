import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars int, n_words string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text), with the other columns and one whose name clashes with results."""
    return lambda rows: spark.createDataFrame([(i, t, "en", "s", None, "kept") for i, t in rows], DOCS)
