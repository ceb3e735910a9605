"""Release audit over a set of drafts: sample, per-draft and per-citation rows, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.rows import unnest

DEFAULT_SEED = 42


def sample_drafts(drafts: DataFrame, size: int | None, seed: int = DEFAULT_SEED) -> DataFrame:
    """Seeded sample of exactly ``size`` drafts (all of them when there are fewer).

    The order of a seeded hash of the path decides, so the pick is the same whatever the
    partitioning. ``size`` is a review sample; Spark keeps the best rows per task and merges
    those.
    """
    if size is None:
        return drafts
    if size < 1:
        raise ValueError(f"sample size must be at least 1, got {size}")
    ticket = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("draft_path")), 256)
    return drafts.orderBy(ticket, "draft_path").limit(size)


def draft_results(audited: DataFrame) -> DataFrame:
    return audited.select(
        "draft_path",
        "section_type",
        F.size("citations").cast("bigint").alias("citation_count"),
        F.size("findings").cast("bigint").alias("finding_count"),
        "passed",
    )


def citation_audit_rows(audited: DataFrame) -> DataFrame:
    """Every citation with its source; an unlabelled one is listed as ``unknown``."""
    rows = unnest(audited, F.col("citations"), "draft_path", "section_type", item="c")
    return rows.select(
        "draft_path",
        "section_type",
        "c.citation_id",
        F.coalesce("c.source_status", F.lit("unknown")).alias("source_status"),
        "c.programme",
        "c.call_id",
        "c.proposal_title",
        "c.section_heading",
        "c.page",
        "c.chunk_id",
    )


def release_totals(audited: DataFrame, total_drafts: DataFrame | None = None) -> DataFrame:
    """One row of counters; an empty set passes."""
    unlabelled = F.size(F.filter("citations", lambda c: c["source_status"].isNull()))
    totals = audited.agg(
        F.count("*").alias("audited_drafts"),
        F.count_if("passed").alias("passed_drafts"),
        F.count_if(~F.col("passed")).alias("failed_drafts"),
        F.coalesce(F.sum(F.size("citations").cast("bigint")), F.lit(0)).alias("citation_count"),
        F.coalesce(F.sum(unlabelled.cast("bigint")), F.lit(0)).alias("unlabeled_citation_count"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )
    if total_drafts is None:
        return totals.withColumn("total_drafts", F.col("audited_drafts"))
    found = total_drafts.agg(F.count("*").alias("total_drafts"))
    both = totals.unionByName(found, allowMissingColumns=True)  # two one-row tables
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
