"""Synthetic corpus of any size, generated where it is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: body text of every synthetic section
SECTION_TEXT = (
    "This section discusses the proposed %s methodology using a "
    "deep learning approach with attention mechanisms. The work plan "
    "covers data collection, model training, validation against a "
    "domain corpus, and an evaluation framework grounded in EU "
    "research-impact metrics. Risks include dataset bias, model drift, "
    "and partner availability; mitigations are documented in the work "
    "plan and revisited at each milestone."
)


def synthetic_corpus(spark: SparkSession, proposals: int = 4, sections: int = 5) -> DataFrame:
    """Parsed documents with metadata; the topic alternates between documents."""
    if proposals < 1 or sections < 1:
        raise ValueError("proposals and sections must be at least 1")
    topic = F.when(F.col("id") % 2 == 0, "methodology").otherwise("impact pathway")

    def section(j):
        part = F.concat(topic, F.lit(" part "), (j + 1).cast("string"))
        before, after = SECTION_TEXT.split("%s")
        return F.struct(
            F.concat(
                F.lit("1."), (j + 1).cast("string"), F.lit(" "), F.initcap(topic),
                F.lit(" chapter "), (j + 1).cast("string"),
            ).alias("heading"),
            F.lit(2).alias("level"),
            F.concat(F.lit(before), part, F.lit(after)).alias("text"),
            (j + 1).alias("page_start"),
            (j + 1).alias("page_end"),
            F.array()
            .cast("array<struct<section_heading: string, rows: array<array<string>>, page: int>>")
            .alias("tables"),
        )

    doc = F.format_string("synthetic-%03d", "id")
    return spark.range(proposals).select(
        doc.alias("document_id"),
        F.concat(F.lit("synthetic/"), doc, F.lit(".pdf")).alias("source_path"),
        F.concat(F.lit("Synthetic proposal "), doc).alias("proposal_title"),
        F.lit("horizon_europe").alias("programme"),
        F.lit("HORIZON-CL5-2024-D3-02").alias("call_id"),
        F.lit(2024).alias("year"),
        F.lit("funded").alias("source_status"),
        F.transform(F.sequence(F.lit(0), F.lit(sections - 1)), section).alias("sections"),
    )
