"""Reading parsed documents, metadata sidecars and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.ids import content_hash, document_id, is_pdf, resolve_source_path
from folioflow.functions.text import iso_utc

SECTION = (
    "struct<heading: string, level: int, text: string, page_start: int, page_end: int, "
    "tables: array<struct<section_heading: string, rows: array<array<string>>, page: int>>>"
)
PARSED_DOCUMENT = (
    f"source_path string, title string, sections array<{SECTION}>, page_count int, "
    "parser string, parsed_at timestamp"
)
PROPOSAL_FIELDS = (
    "programme string, call_id string, topic_id string, year int, outcome string, "
    "proposal_title string, consortium_acronym string, source_path string, language string, "
    "ingested_at timestamp, content_hash string"
)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON document per file, with a fixed schema."""
    df = (
        spark.read.schema(PARSED_DOCUMENT)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "FAILFAST")
        .json(path)
    )
    return df.withColumn("document_id", document_id(F.col("source_path")))


def write_parsed(parsed: DataFrame, path: str) -> None:
    parsed.write.mode("errorifexists").json(path)


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Metadata sidecars, flat or nested under ``proposal``; a non-object file fails.

    A relative ``source_path`` is resolved against the folder of its own sidecar.
    """
    nested = ", ".join(f.strip().replace(" ", ": ", 1) for f in PROPOSAL_FIELDS.split(","))
    raw = (
        spark.read.schema(f"{PROPOSAL_FIELDS}, proposal struct<{nested}>")
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "FAILFAST")
        .json(path)
        .withColumn("sidecar", F.col("_metadata.file_path"))
    )
    names = [f.strip().split(" ")[0] for f in PROPOSAL_FIELDS.split(",")]
    is_nested = F.col("proposal").isNotNull()
    flat = raw.select(
        *[
            F.when(is_nested, F.col(f"proposal.{n}")).otherwise(F.col(n)).alias(n) for n in names
        ],
        F.regexp_replace("sidecar", r"\Afile:/+", "/").alias("sidecar"),
    )
    return (
        flat.withColumn("source_path", resolve_source_path(F.col("source_path"), F.col("sidecar")))
        .withColumn("language", F.coalesce("language", F.lit("en")))
        .withColumn("document_id", document_id(F.col("source_path")))
    )


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, content_hash, bytes) of every PDF below ``path``.

    The glob keeps other files from being read at all. ``binaryFile`` holds one file per row, so a
    file is bounded by the 2 GB cell.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .load(path)
    ).filter(is_pdf(F.col("path")))
    return files.select(
        "path",
        document_id(F.col("path")).alias("document_id"),
        content_hash(F.col("content")).alias("content_hash"),
        F.col("length").alias("bytes"),
    )


def flatten_metadata(chunks: DataFrame) -> DataFrame:
    """Nested chunk metadata as dotted columns; an absent value stays null, a time is ISO text in UTC."""
    m = F.col("metadata")

    def plain(name: str):
        value = m["proposal"][name]
        return iso_utc(value) if name == "ingested_at" else value

    fields = {
        **{f"proposal.{f}": plain(f) for f in _struct_fields(chunks, "proposal")},
        **{f"anchor.{f}": m["anchor"][f] for f in _struct_fields(chunks, "anchor")},
        "section_type": m["section_type"],
        "parent_section_heading": m["parent_section_heading"],
        "chunk_index": m["chunk_index"],
        "source_status": m["source_status"],
    }
    return chunks.select("chunk_id", "text", *[c.alias(n) for n, c in fields.items()])


def unflatten_metadata(flat: DataFrame) -> DataFrame:
    """Inverse of ``flatten_metadata``."""

    def group(prefix: str):
        names = [c for c in flat.columns if c.startswith(f"{prefix}.")]
        columns = {n.split(".", 1)[1]: F.col(f"`{n}`") for n in names}
        if "ingested_at" in columns:
            columns["ingested_at"] = columns["ingested_at"].cast("timestamp")
        return F.struct(*[c.alias(n) for n, c in columns.items()]).alias(prefix)

    return flat.select(
        "chunk_id",
        "text",
        F.struct(
            group("proposal"),
            "section_type",
            "parent_section_heading",
            "chunk_index",
            group("anchor"),
            "source_status",
        ).alias("metadata"),
    )


def _struct_fields(chunks: DataFrame, part: str) -> list[str]:
    return chunks.select(f"metadata.{part}").schema[part].dataType.names
