"""JSON-lines logs: append with sorted keys, export copies, egress records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import is_blank
from folioflow.operators.events import event_lines


def sorted_columns(df: DataFrame) -> DataFrame:
    """Column order decides JSON key order, so sorted columns give canonical lines."""
    return df.select(*sorted(df.columns))


def append_log(events: DataFrame, path: str) -> None:
    """Append one canonical JSON line per row; a null field is written as null."""
    sorted_columns(events).write.mode("append").option("ignoreNullFields", False).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append typed usage events, each with the fields of its own type and nulls as null."""
    event_lines(events).write.mode("append").text(path)


def worth_exporting(line: Column) -> Column:
    """Blank lines are left out of an export."""
    return ~is_blank(line)


def export_lines(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> int:
    """Copy a log's non-blank lines; refuse an existing target unless told otherwise.

    Returns the number of lines that were written.
    """
    lines = spark.read.text(source).filter(worth_exporting(F.col("value")))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(target)
    return spark.read.text(target).count()
