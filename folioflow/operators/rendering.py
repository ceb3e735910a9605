"""Drafts to Markdown with a reference table and status notes, and the export gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import (
    escape_pipes,
    humanise,
    lookup,
    page_note,
    rstrip,
    section_or_na,
    title_or_untitled,
)


def _table_row(c: Column) -> Column:
    cells = [
        escape_pipes(lookup(c["source_status"], vocab.STATUS_LABEL, F.lit(""))),
        escape_pipes(humanise(F.coalesce(c["programme"], F.lit("")))),
        escape_pipes(F.coalesce(c["call_id"], F.lit(""))),
        escape_pipes(section_or_na(c["section_heading"])),
        F.coalesce(c["page"].cast("string"), F.lit("n/a")),
        escape_pipes(title_or_untitled(c["proposal_title"])),
    ]
    return F.concat(
        F.lit("| "), F.concat_ws(" | ", c["citation_id"].cast("string"), *cells), F.lit(" |")
    )


def _note(c: Column) -> Column:
    caveat = lookup(c["source_status"], vocab.STATUS_CAVEAT, F.lit(""))
    line = F.concat(
        F.lit("- ["), c["citation_id"].cast("string"), F.lit("] "),
        lookup(c["source_status"], vocab.STATUS_BADGE, F.lit("")), F.lit(" — "),
        humanise(F.coalesce(c["programme"], F.lit(""))), F.lit(" call "),
        F.coalesce(c["call_id"], F.lit("")), F.lit(", "), page_note(c["page"]), F.lit(", §"),
        section_or_na(c["section_heading"]),
    )
    return F.concat(
        line, F.when(caveat != "", F.concat(F.lit("\n  "), caveat)).otherwise(F.lit(""))
    )


def references(citations: Column) -> Column:
    listed = F.concat(
        F.lit(vocab.REFERENCES_TABLE_HEAD + "\n"),
        F.array_join(F.transform(citations, _table_row), "\n"),
        F.lit("\n\n### Notes\n\n"),
        F.array_join(F.transform(citations, _note), "\n"),
    )
    return F.when(F.size(citations) > 0, listed).otherwise(F.lit("_No citations._"))


def markdown(section_type: Column, text: Column, citations: Column) -> Column:
    return F.concat(
        F.lit("# "),
        humanise(section_type),
        F.lit("\n\n"),
        rstrip(text),
        F.lit(f"\n\n{vocab.REFERENCES_HEADING}\n\n"),
        references(citations),
        F.lit("\n"),
    )


def render(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn(
        "rendered", markdown(F.col("section_type"), F.col("text"), F.col("citations"))
    )


def export(audited: DataFrame) -> DataFrame:
    """Rendered drafts that pass their audit, with the UTF-8 size of what is written."""
    return audited.filter("passed").select(
        "draft_path",
        "section_type",
        F.col("rendered").alias("payload"),
        F.octet_length("rendered").cast("bigint").alias("byte_count"),
    )
