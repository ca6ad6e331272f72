import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ctxlens.runtime import apply_settings

    session = (
        SparkSession.builder.master("local[4]")
        .appName("ctxlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return apply_settings(session)


@pytest.fixture
def texts(spark):
    """Rows of one text column, in the given order."""

    def make(*values):
        rows = list(enumerate(values))
        return spark.createDataFrame(rows, "id int, text string").coalesce(1)

    return make
