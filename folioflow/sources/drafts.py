"""Reading saved drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.citations import CITATION

DRAFT = (
    f"section_type string, text string, citations array<{CITATION}>, prompt_used string, "
    "model string, generated_at timestamp, "
    "iterations array<struct<iteration_index: int, changes_summary: string, "
    "requirements_checked: array<string>, critique_text: string, generated_at: timestamp>>"
)


def read_drafts(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """Every draft file below ``directory``, keyed by its relative path.

    ``pattern`` keeps report files that live in the same folder out. A file that is not a
    draft fails the job rather than dropping out of a release audit.
    """
    df = (
        spark.read.schema(DRAFT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("mode", "FAILFAST")
        .json(directory)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    base = directory.rstrip("/").split(":", 1)[-1]
    relative = F.regexp_replace("file", rf"\A[a-z0-9]*:?/*\Q{base.lstrip('/')}\E/", "")
    return df.withColumn("draft_path", relative).drop("file")
