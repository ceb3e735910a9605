"""Pilot roll-ups: section results, coordinator ratings, go / no-go verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASS_MEAN = 4.0


def section_results(audited: DataFrame) -> DataFrame:
    """Per draft: citations, text length, elapsed time and whether it has no errors."""
    return audited.select(
        "draft_path",
        "section_type",
        F.size("citations").cast("bigint").alias("citation_count"),
        F.length("text").cast("bigint").alias("draft_length"),
        "elapsed_ms",
        F.col("passed").alias("audit_passed"),
    )


def attach_ratings(sections: DataFrame, ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, unknown): ratings of existing sections, and those that name none."""
    keys = sections.select("pilot_id", "section_type").distinct()
    on = ["pilot_id", "section_type"]
    return ratings.join(keys, on, "left_semi"), ratings.join(keys, on, "left_anti")


def section_outcomes(sections: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per section its mean rating and, where it decides the verdict, the outcome.

    Ratings are summed before they meet the sections; null ratings do not count.
    """
    summed = (
        ratings.filter(F.col("rating").isNotNull())
        .groupBy("pilot_id", "section_type")
        .agg(F.avg("rating").alias("mean_rating"), F.count("*").alias("ratings"))
    )
    outcome = F.when(F.col("mean_rating").isNull(), "conditional").when(
        F.col("mean_rating") < PASS_MEAN, "no_go"
    )
    return sections.join(summed, ["pilot_id", "section_type"], "left").select(
        "pilot_id",
        "section_pos",
        "section_type",
        "mean_rating",
        F.coalesce("ratings", F.lit(0)).alias("ratings"),
        outcome.alias("deciding"),
    )


def verdicts(pilots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Verdict per pilot (pilot_id, mode, smoke_passed, audit_passed, smoke_blocking).

    The first deciding section in section order wins; a pilot without sections goes.
    """
    first = (
        outcomes.filter(F.col("deciding").isNotNull())
        .groupBy("pilot_id")
        .agg(F.min_by("deciding", "section_pos").alias("deciding"))
    )
    smoke = F.col("mode") == "smoke"
    verdict = (
        F.when(~F.col("smoke_passed"), "no_go")
        .when(~smoke & ~F.col("audit_passed"), "no_go")
        .when(smoke & F.col("smoke_blocking"), "no_go")
        .when(smoke, "conditional")
        .otherwise(F.coalesce("deciding", F.lit("go")))
    )
    return pilots.join(first, "pilot_id", "left").select(
        "pilot_id", "mode", verdict.alias("verdict")
    )
