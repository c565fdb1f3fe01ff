import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logwarden import schema  # noqa: E402

START = dt.datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        # not UTC on purpose: results may not depend on the session zone
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make_logs(spark):
    """Log table from (seconds after START, source, raw) rows, numbered in order."""
    def make(rows):
        data = [(n, START + dt.timedelta(seconds=s), source, raw) for n, (s, source, raw) in enumerate(rows)]
        return spark.createDataFrame(data, schema.RAW_LOGS)
    return make
