import os

import pytest
from pyspark.sql import SparkSession

from corpusaudit.session import configure

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpusaudit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Build a files table from (corpus, path, content) tuples."""

    def make(*rows, modified_at=None):
        return spark.createDataFrame(list(rows), "corpus STRING, path STRING, content STRING")

    return make


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)
