from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from pyspark.sql import SparkSession  # noqa: E402

from folioflow.session import ship_package  # noqa: E402


# started on import: columns at module level of a test need an active session
SESSION = (
    SparkSession.builder.master("local[4]")
    .appName("folioflow-tests")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "6g")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")
ship_package(SESSION)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column expression over one row of named values."""

    def evaluate(build, schema: str, *values):
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(build.alias("out")).first()["out"]

    return evaluate
