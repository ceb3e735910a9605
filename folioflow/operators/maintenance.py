"""Pure table-to-table maintenance steps; ``sources.chunk_table`` applies them to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.lineage import broadcast_if_small, materialise


def _without(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key is not among ``ids``.

    Ids that a join can carry along are sent to the rows, so no text moves. More of them meet the rows by
    a join on the key, where a table that is stored bucketed by it stays in place, too.
    """
    return existing.join(broadcast_if_small(materialise(ids.select(key).distinct())), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by chunk id; running it twice changes nothing."""
    return _without(existing, new, "chunk_id").unionByName(new)


def delete_documents(existing: DataFrame, documents: DataFrame) -> DataFrame:
    return _without(existing, documents, "document_id")


def removed_counts(existing: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks each deleted document loses (0 when it is not indexed)."""
    counts = existing.groupBy("document_id").agg(F.count("*").alias("n"))
    return (
        documents.select("document_id")
        .distinct()
        .join(counts, "document_id", "left")
        .select("document_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("removed"))
    )


def reindex(existing: DataFrame, replaced: DataFrame, new: DataFrame) -> DataFrame:
    """Drop every chunk of the replaced documents, then upsert: no orphans remain."""
    return upsert(delete_documents(existing, replaced), new)
