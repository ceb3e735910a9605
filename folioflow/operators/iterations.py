"""Draft iterations: requirements, change summaries, cumulative history, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import is_blank, shorten, strip


def requirements_checked(expected_outputs: Column, guidance_sections: Column) -> Column:
    """Sentinel, profile outputs, then ``topic:<section>``: trimmed, distinct, in order."""
    outputs = F.coalesce(expected_outputs, F.array().cast("array<string>"))
    topics = F.transform(
        F.coalesce(guidance_sections, F.array().cast("array<string>")),
        lambda s: F.concat(F.lit("topic:"), s),
    )
    everything = F.transform(
        F.concat(F.array(F.lit(vocab.DEFAULT_REQUIREMENT)), outputs, topics), strip
    )
    return F.array_distinct(F.filter(everything, lambda x: x != ""))


def _signed(delta: Column) -> Column:
    return F.concat(F.when(delta >= 0, "+").otherwise(""), delta.cast("string"))


def changes_summary(char_delta: Column, citation_delta: Column) -> Column:
    """Narrative with signed character and citation deltas.

    An unchanged length with changed citations counts as tightened.
    """
    narrative = (
        F.when((char_delta == 0) & (citation_delta == 0), vocab.CHANGE_NONE)
        .when(char_delta > 0, vocab.CHANGE_GROWN)
        .otherwise(vocab.CHANGE_SHRUNK)
    )
    return F.concat(
        narrative, F.lit(" text "), _signed(char_delta), F.lit(" chars, citations "),
        _signed(citation_delta), F.lit("."),
    )


def checked_cap(max_iterations: int) -> int:
    """Refuse non-positive caps, clamp to the ceiling, insist on one refinement pass."""
    if max_iterations < 1:
        raise ValueError(f"max_iterations must be at least 1, got {max_iterations}")
    cap = min(max_iterations, vocab.MAX_ITERATIONS)
    if cap < 2:
        raise ValueError("max_iterations must allow at least one refinement pass")
    return cap


def cap_critique(critique: Column) -> Column:
    return F.when(is_blank(critique), F.lit(vocab.EMPTY_CRITIQUE)).otherwise(
        shorten(critique, vocab.MAX_CRITIQUE_CHARS)
    )


def iteration_records(
    versions: DataFrame, max_iterations: int = vocab.MAX_ITERATIONS
) -> DataFrame:
    """One record per refinement: versions are (draft_id, iteration, text, citations, critique).

    The cap is applied first, so a draft's window holds at most ``MAX_ITERATIONS`` rows no
    matter how many versions were kept of it. Only lengths travel through the shuffle.
    """
    cap = checked_cap(max_iterations)
    sized = versions.filter(F.col("iteration") <= cap).select(
        "draft_id",
        "iteration",
        F.length("text").alias("chars"),
        F.size("citations").alias("cites"),
        cap_critique(F.col("critique")).alias("critique_text"),
    )
    w = Window.partitionBy("draft_id").orderBy("iteration")
    return (
        sized.withColumn("char_delta", F.col("chars") - F.lag("chars").over(w))
        .withColumn("citation_delta", F.col("cites") - F.lag("cites").over(w))
        .filter(F.col("iteration") >= 2)
        .select(
            "draft_id",
            F.col("iteration").alias("iteration_index"),
            changes_summary(F.col("char_delta"), F.col("citation_delta")).alias("changes_summary"),
            "critique_text",
            (F.col("iteration") >= cap).alias("stopped"),
        )
    )


def cumulative_history(records: DataFrame) -> DataFrame:
    """Each iteration with the list of all records so far and the number of passes."""
    w = (
        Window.partitionBy("draft_id")
        .orderBy("iteration_index")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    history = F.collect_list(F.struct("iteration_index", "changes_summary")).over(w)
    return records.withColumn("history", history).withColumn(
        "total_iterations", F.size("history") + 1
    )
