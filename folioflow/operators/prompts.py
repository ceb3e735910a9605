"""Drafting prompts for a table of requests: the input table of a batch text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import empty_to_null, humanise, strip
from folioflow.operators.citations import evidence_text

# --- fixed values: prompt text --------------------------------------------------------------

TITLE = "# EU Proposal Section Drafting Task\n"
ANY_PROGRAMME = "Any (no programme filter)"
OUTPUTS_INTRO = "Consider including the following elements where relevant:\n"
TOPIC_GUIDANCE = "**Topic requirements for this section:** "
EVIDENCE_INTRO = (
    "Use the following examples from past proposals as inspiration. "
    "Each example is labeled with its source status. **Funded** examples "
    "represent successful patterns; **Rejected** examples are cautionary; "
    "**ESR notes** are advisory commentary, not ground truth. Cite each "
    "example you use as [N].\n"
)
OUTPUT_INSTRUCTIONS = (
    "Write a concise, technically precise draft of the section in markdown. "
    "Cite supporting evidence inline using [N] markers matching the numbered "
    "list above. Do not invent information not supported by the retrieved "
    "evidence. If a citation is from a REJECTED example, frame it as a "
    "cautionary lesson. Do not cite ESR notes as fact."
)
OUTCOMES_INSTRUCTION = (
    " Reference the supplied Expected Outcomes from the call / topic "
    "context where appropriate, framing the draft so it explicitly "
    "addresses the topic's intended outcomes."
)
NONE_PROVIDED = "(none provided)"


def _text(value: str) -> Column:
    return F.lit(value)


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"**{label}:** "), empty_to_null(value))


def topic_block(topic: Column, notes: Column) -> Column:
    """Call context: labelled topic fields and free-text notes; unset fields are left out."""
    free = strip(F.coalesce(notes, F.lit("")))
    outcomes = topic["expected_outcomes"]
    parts = [
        _labelled("Programme", humanise(topic["programme"])),
        _labelled("Call ID", topic["call_id"]),
        _labelled("Topic ID", topic["topic_id"]),
        _labelled("Topic title", topic["topic_title"]),
        _labelled("Destination", topic["destination"]),
        F.when(
            F.size(outcomes) > 0,
            F.concat(
                F.lit("\n**Expected outcomes:**\n"),
                F.array_join(F.transform(outcomes, lambda o: F.concat(F.lit("* "), o)), "\n"),
            ),
        ),
        F.concat(F.lit("\n**Scope:** "), empty_to_null(topic["scope"])),
        F.when(free != "", F.concat(F.lit("\n**Free-text notes:**\n"), free)),
    ]
    structured = strip(F.concat_ws("\n", *parts))
    chosen = F.when(topic.isNull(), free).otherwise(structured)
    return F.when(chosen == "", F.lit(NONE_PROVIDED)).otherwise(chosen)


def prompt_text(
    section_type: Column,
    programme: Column,
    intent: Column,
    guidance: Column,
    topic_guidance: Column,
    outputs: Column,
    context: Column,
    evidence: Column,
    has_outcomes: Column,
) -> Column:
    label = F.coalesce(humanise(programme), F.lit(ANY_PROGRAMME))
    extra = F.concat(F.lit(f"\n{TOPIC_GUIDANCE}"), empty_to_null(topic_guidance), F.lit("\n"))
    listed = F.concat(
        F.lit("\n## Expected outputs\n" + OUTPUTS_INTRO),
        F.array_join(F.transform(outputs, lambda o: F.concat(F.lit("* "), o)), "\n"),
        F.lit("\n"),
    )
    nothing = F.lit("")
    return F.concat(
        _text(TITLE + "\n**Section type:** "), humanise(section_type),
        _text("\n**Programme:** "), label,
        _text("\n**User intent:** "), intent,
        _text("\n\n## Section guidance\n"), guidance, _text("\n"),
        F.coalesce(extra, nothing),
        F.when(F.size(outputs) > 0, listed).otherwise(nothing),
        _text("\n## Call / topic context\n"), context,
        _text("\n\n## Retrieved evidence\n" + EVIDENCE_INTRO + "\n"), evidence,
        _text("\n\n## Output instructions\n" + OUTPUT_INSTRUCTIONS),
        F.when(has_outcomes, _text(OUTCOMES_INSTRUCTION)).otherwise(nothing),
        _text("\n"),
    )


def build_prompts(
    requests: DataFrame, citations: DataFrame, guidance: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Requests (query_id, section_type, query, call_context, programme, topic) joined with
    their citation lists and the guidance dimensions."""
    section = F.coalesce("section_type", F.lit("other"))
    r = requests.withColumn("section_type", section)
    joined = (
        r.join(citations, "query_id", "left")
        .join(guidance, "section_type", "left")
        .join(profiles, ["programme", "section_type"], "left")
    )
    topic = F.col("topic")
    prompt = prompt_text(
        F.col("section_type"),
        F.col("programme"),
        F.col("query"),
        F.coalesce("profile_guidance", "guidance"),
        topic["section_guidance"][F.col("section_type")],
        F.coalesce("expected_outputs", F.array().cast("array<string>")),
        topic_block(topic, F.col("call_context")),
        evidence_text(F.col("citations")),
        F.coalesce(F.size(topic["expected_outcomes"]) > 0, F.lit(False)),
    )
    return joined.select(
        "query_id",
        "section_type",
        "profile_name",
        prompt.alias("prompt"),
        F.coalesce(F.size("citations"), F.lit(0)).cast("bigint").alias("citation_count"),
    )
