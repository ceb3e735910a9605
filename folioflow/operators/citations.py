"""Ranked results to citation lists, evidence text and marker checks.

A draft is one row with its ``citations`` array; checks on it are array expressions inside
the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import (
    citation_markers,
    empty_to_null,
    humanise,
    lookup,
    rstrip,
    snippet,
)
from folioflow.operators.lineage import broadcast_if_small, materialise

CITATION = (
    "struct<citation_id: int, source_status: string, programme: string, call_id: string, "
    "proposal_title: string, section_heading: string, page: int, chunk_id: string, snippet: string>"
)


def citation_rows(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One citation per ranked result.

    Results are settled first, since their number decides the join: a small set travels to
    the chunk table, whose texts then stay where they are.
    """
    results = broadcast_if_small(materialise(results))
    shown = chunks.select(
        "chunk_id", "programme", "call_id", "proposal_title", "section_heading", "page", "text"
    )
    return results.join(shown, "chunk_id").select(
        "query_id",
        F.col("rank").cast("int").alias("citation_id"),
        "source_status",
        "programme",
        "call_id",
        "proposal_title",
        empty_to_null(F.col("section_heading")).alias("section_heading"),
        F.col("page").cast("int").alias("page"),
        "chunk_id",
        snippet(F.col("text")).alias("snippet"),
    )


def citation_lists(rows: DataFrame) -> DataFrame:
    """(query_id, citations) with citations in rank order; a list holds at most ``top_k``."""
    fields = [c for c in rows.columns if c != "query_id"]
    return rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("citations")
    )


def evidence_text(citations: Column) -> Column:
    """Numbered evidence block that a drafting prompt quotes from."""

    def entry(c: Column) -> Column:
        page = F.coalesce(F.concat(F.lit("p. "), c["page"].cast("string")), F.lit("p. ?"))
        section = F.coalesce(empty_to_null(c["section_heading"]), F.lit("(no section heading)"))
        head = F.concat(
            F.lit("["), c["citation_id"].cast("string"), F.lit("] **"),
            lookup(c["source_status"], vocab.PROMPT_STATUS_LABEL), F.lit("** — "),
            humanise(c["programme"]), F.lit(" call "), c["call_id"], F.lit(", "),
            page, F.lit(", §"), section,
        )
        return F.concat(head, F.lit("\n    > "), c["snippet"])

    listed = rstrip(F.array_join(F.transform(citations, entry), "\n\n"))
    return F.when(
        F.coalesce(F.size(citations), F.lit(0)) > 0, listed
    ).otherwise(F.lit("(no examples retrieved)"))


def citation_ids(citations: Column) -> Column:
    """Citation ids as digit strings, comparable with marker digits."""
    return F.transform(citations, lambda c: c["citation_id"].cast("string"))


def marker_check(drafts: DataFrame) -> DataFrame:
    """Bounded ``[N]`` markers that name no citation; a draft without markers only warns."""
    markers = citation_markers(F.col("text"), max_digits=2)
    invalid = F.sort_array(
        F.transform(
            F.array_except(markers, citation_ids(F.col("citations"))), lambda m: m.cast("int")
        )
    )
    return drafts.select(
        "draft_path",
        F.size(markers).cast("bigint").alias("markers"),
        (F.size(markers) == 0).alias("no_markers"),
        invalid.alias("invalid_markers"),
        (F.size(invalid) == 0).alias("valid"),
    )


def status_mix(citations: Column) -> Column:
    """Map of source status to its number of citations, absent statuses left out."""
    counted = F.transform(
        F.array(*[F.lit(s) for s in vocab.SOURCE_STATUSES]),
        lambda s: F.struct(
            s.alias("key"),
            F.size(F.filter(citations, lambda c: c["source_status"] == s)).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(counted, lambda e: e["value"] > 0))
