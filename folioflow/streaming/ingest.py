"""Incremental ingest: new parsed documents flow into the chunk table batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.chunking import ChunkSizes, chunk_documents
from folioflow.operators.dedup import admission, decide_batch, survivors
from folioflow.operators.embedding import hash_embedding
from folioflow.sources.chunk_table import ChunkTable
from folioflow.sources.documents import SECTION

INCOMING = (
    "position bigint, document_id string, content_hash string, proposal_title string, "
    "call_id string, programme string, topic_id string, year int, source_status string, "
    f"sections array<{SECTION}>"
)
KEYS = ("position", "document_id", "content_hash", "proposal_title", "call_id")


def ingest_batch(
    table: ChunkTable,
    incoming: DataFrame,
    source: tuple[str, int] | None = None,
    *,
    force: bool = False,
    sizes: ChunkSizes = ChunkSizes(),
    embed: Callable[[Column], Column] = hash_embedding,
) -> DataFrame:
    """Decide, admit, chunk, embed and store one batch; returns the admission table.

    Decisions look only at key columns. Texts are read for admitted documents alone, so a
    refused duplicate costs neither chunking nor a model call. ``source`` is the (stream, batch
    id) of the rows: a batch that is tried again is decided on the table as it was, and stored once.
    """
    keys = incoming.select(*KEYS)
    live = table.read(before=table.version_of(*source) if source else None)
    known = keys.limit(0) if live is None else live
    admitted = survivors(admission(decide_batch(keys, known, force), force))
    # a record that a later row of the batch replaced is never stored
    chosen = admitted.filter("stays")
    documents = incoming.join(chosen.select("position"), "position", "left_semi").drop("position")
    chunks = chunk_documents(documents, sizes).withColumn("embedding", embed(F.col("text")))
    replaced = admitted.filter(F.col("replaced_document_id").isNotNull()).select(
        F.col("replaced_document_id").alias("document_id")
    )
    table.replace_documents(replaced, chunks, source)
    return admitted


def ingest_stream(
    spark: SparkSession, inbox: str, table: ChunkTable, checkpoint: str, files_per_batch: int = 1000, *, force: bool = False
) -> StreamingQuery:
    """Watch a folder of incoming documents (JSON lines) and keep the table current.

    With ``force`` a suspected duplicate replaces the record it conflicts with.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # the id is born with the checkpoint, so a new checkpoint is a new stream
        stored = spark.read.text(f"{checkpoint}/metadata").first()["value"]
        ingest_batch(table, batch, (json.loads(stored)["id"], batch_id), force=force)

    return (
        spark.readStream.schema(INCOMING)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(inbox)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
