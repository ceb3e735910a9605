"""Making the package importable on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: The Spark setting that ends an Arrow batch by its bytes, and the value that text needs.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Functions that run in Python workers import it by name, and workers do not share the
    driver's import path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / root.name
    archive = shutil.make_archive(str(target), "zip", root.parent, root.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end by bytes, too, unless it has such a bound already.

    The number of rows alone lets a batch, which the executor and its worker hold once each, grow with the texts.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
