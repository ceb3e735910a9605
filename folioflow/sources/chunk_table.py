"""The stored chunk table: append-only versions with a commit marker.

    <path>/<collection>/chunks/batch=N     rows written by version N
    <path>/<collection>/removed/batch=N    chunk ids of earlier versions that N supersedes
    <path>/<collection>/commits/batch=N    written last; a version without it does not exist

A collection is a folder of its own, named by its whole text. A change costs as much as the change:
nothing that is stored gets rewritten, and no path is ever read and written at once. Readers see a
version whole or not at all.

Versions are numbered by the table alone. A stream's batch is known by (stream, batch id), which its
commit holds: a batch that is tried again is skipped, and no other write can take its place. There is
one writer at a time per collection.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.lineage import broadcast_if_small, materialise


@dataclass(frozen=True)
class ChunkTable:
    spark: SparkSession
    path: str
    collection: str

    # --- reading -----------------------------------------------------------------------

    def _folder(self, kind: str) -> str:
        name = quote(self.collection, safe="")
        return f"{self.path}/collection-{name}/{kind}"

    def _part(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._folder(kind))
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _log(self) -> list[tuple[int, str, str | None, int | None]]:
        """(version, op, stream, stream batch), oldest first; one small row per version."""
        df = self._part("commits")
        if df is None:
            return []
        rows = df.select("batch", "op", "stream", "stream_batch").collect()
        return sorted((r["batch"], r["op"], r["stream"], r["stream_batch"]) for r in rows)

    def commits(self) -> list[tuple[int, str]]:
        """(version, op) of this collection, oldest first."""
        return [(version, op) for version, op, _, _ in self._log()]

    def version_of(self, stream: str, stream_batch: int) -> int | None:
        """The version that stored a stream's batch; None if none has."""
        found = [v for v, _, s, b in self._log() if (s, b) == (stream, stream_batch)]
        return found[0] if found else None

    def _live_batches(self, before: int | None = None) -> list[int]:
        log = [(b, op) for b, op in self.commits() if before is None or b < before]
        resets = [b for b, op in log if op == "replace"]
        return [b for b, _ in log if not resets or b >= resets[-1]]

    def next_batch(self) -> int:
        log = self.commits()
        return log[-1][0] + 1 if log else 0

    def read(self, before: int | None = None) -> DataFrame | None:
        """Live chunks (of versions before ``before``); None while nothing was written.

        A row lives unless a later batch names its chunk id. The list of superseded ids is
        short next to the table, so Spark usually broadcasts it.
        """
        batches = self._live_batches(before)
        chunks = self._part("chunks")
        if chunks is None or not batches:
            return None
        chunks = chunks.filter(F.col("batch").isin(*batches))
        removed = self._part("removed")
        if removed is not None:
            last = (
                removed.filter(F.col("batch").isin(*batches))
                .groupBy("chunk_id")
                .agg(F.max("batch").alias("removed_in"))
            )
            chunks = chunks.join(last, "chunk_id", "left").filter(
                F.col("removed_in").isNull() | (F.col("removed_in") <= F.col("batch"))
            )
            chunks = chunks.drop("removed_in")
        return chunks.drop("batch")

    def count(self) -> int:
        live = self.read()
        return 0 if live is None else live.count()

    # --- writing -----------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._folder(kind)}/batch={batch}")

    def _commit(self, batch: int, op: str, source: tuple[str, int] | None = None) -> None:
        stream, number = source or (None, None)
        row = [(op, stream, number)]
        marker = self.spark.createDataFrame(row, "op string, stream string, stream_batch bigint").coalesce(1)
        # fails if another writer took the number
        marker.write.mode("errorifexists").parquet(f"{self._folder('commits')}/batch={batch}")

    def upsert(self, new: DataFrame, source: tuple[str, int] | None = None) -> int:
        """Insert or replace by chunk id."""
        return self.replace_documents(None, new, source)

    def replace_documents(
        self, replaced: DataFrame | None, new: DataFrame | None, source: tuple[str, int] | None = None
    ) -> int:
        """Delete the documents in ``replaced`` and upsert ``new`` as one version; returns its number.

        ``source`` is the (stream, batch id) that the rows come from, if any. What it has stored
        before is not stored again.
        """
        stored = self.version_of(*source) if source else None
        if stored is not None:
            return stored
        batch = self.next_batch()
        live = self.read(before=batch)
        if new is not None:
            self._write(new, "chunks", batch)
            new = self.spark.read.parquet(f"{self._folder('chunks')}/batch={batch}")
        if live is not None:
            gone = []
            if replaced is not None:
                ids = broadcast_if_small(materialise(replaced.select("document_id").distinct()))
                gone.append(live.join(ids, "document_id", "left_semi").select("chunk_id"))
            if new is not None:
                ids = broadcast_if_small(new.select("chunk_id"))
                gone.append(live.select("chunk_id").join(ids, "chunk_id", "left_semi"))
            if gone:
                superseded = gone[0]
                for more in gone[1:]:
                    superseded = superseded.union(more)
                self._write(superseded.distinct(), "removed", batch)
        self._commit(batch, "write", source)
        return batch

    def delete_documents(self, documents: DataFrame) -> int:
        return self.replace_documents(documents, None)

    def drop(self) -> int:
        """Empty the collection; earlier batches stop being read."""
        batch = self.next_batch()
        self._commit(batch, "replace")
        return batch

    def compact(self) -> int:
        """Rewrite the live rows as one batch that supersedes all earlier ones."""
        live = self.read()
        batch = self.next_batch()
        if live is not None:
            self._write(live, "chunks", batch)
        self._commit(batch, "replace")
        return batch
