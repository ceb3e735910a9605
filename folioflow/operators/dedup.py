"""Duplicate decisions for incoming documents against the indexed ones.

Every lookup side is reduced to one row per key before it is joined (partial aggregation on
the map side), so a hash shared by a third of all documents is one row, not a group. The
incoming side of each join may still carry a hot key; these are plain equi joins with the
big side on the left, which adaptive execution splits at run time.

Null hashes, blank titles and null calls never match; such rows pass by the joins, where they
would meet in one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioflow.functions.text import is_blank
from folioflow.operators.groups import connected, key_links
from folioflow.operators.lineage import broadcast_if_small, materialise

NONE, REINDEX, BLOCK_HARD, BLOCK_SOFT = "none", "reindex", "block_hard", "block_soft"


def registry(chunks: DataFrame) -> DataFrame:
    """One row per indexed document, from its chunks."""
    return chunks.groupBy("document_id").agg(
        F.min("content_hash").alias("content_hash"),
        F.min("proposal_title").alias("proposal_title"),
        F.min("call_id").alias("call_id"),
        F.count("*").alias("chunk_count"),
    )


def matching_documents(chunks: DataFrame, incoming: DataFrame) -> DataFrame:
    """The part of ``registry`` a batch can meet: documents that share a hash, an id or a
    title and call with it.

    Three scans of the narrow key columns against the batch's keys. The keys of a small batch
    travel to the table, so nothing of it is shuffled but the hits.
    """
    incoming = materialise(incoming.select("content_hash", "document_id", "proposal_title", "call_id"))
    columns = ["document_id", "content_hash", "proposal_title", "call_id"]
    narrow = chunks.select(*columns)
    keys = (["content_hash"], ["document_id"], ["proposal_title", "call_id"])
    hits = [
        narrow.join(broadcast_if_small(incoming.select(*k)), k, "left_semi").select(*columns)
        for k in keys
    ]
    return hits[0].union(hits[1]).union(hits[2]).distinct()


def by_content_hash(indexed: DataFrame) -> DataFrame:
    """content_hash, first document id, number of documents."""
    return (
        indexed.filter(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.min("document_id").alias("hash_match"), F.count("*").alias("documents"))
    )


def by_title_and_call(indexed: DataFrame) -> DataFrame:
    """proposal_title, call_id, first document id, number of documents."""
    return (
        indexed.filter(~is_blank(F.col("proposal_title")))
        .groupBy("proposal_title", "call_id")
        .agg(F.min("document_id").alias("title_match"), F.count("*").alias("documents"))
    )


def by_document_id(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def _looked_up(incoming: DataFrame, found: DataFrame, keys: list[str], column: str, matchable: Column) -> DataFrame:
    """``incoming`` with ``column`` of the key's row in ``found``; rows that cannot match skip the join."""
    known = F.coalesce(matchable, F.lit(False))
    alone = incoming.filter(~known).withColumn(column, F.lit(None).cast(found.schema[column].dataType))
    return incoming.filter(known).join(found, keys, "left").unionByName(alone)


def _with_matches(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    known = indexed.select("document_id").distinct().withColumn("id_match", F.lit(True))
    titled = ~is_blank(F.col("proposal_title")) & F.col("call_id").isNotNull()
    out = _looked_up(
        incoming, by_content_hash(indexed).drop("documents"), ["content_hash"], "hash_match", F.col("content_hash").isNotNull()
    )
    out = out.join(known, "document_id", "left")
    return _looked_up(out, by_title_and_call(indexed).drop("documents"), ["proposal_title", "call_id"], "title_match", titled)


def decide_duplicates(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each incoming document on its own against the index.

    Same bytes block hard; else a known id re-indexes; else the same title and call under
    another id blocks softly; else there is no duplicate. A title match can only be another
    document here, because a known id has been decided before.
    """
    decided = _with_matches(incoming, indexed)
    action = (
        F.when(F.col("hash_match").isNotNull(), BLOCK_HARD)
        .when(F.col("id_match"), REINDEX)
        .when(F.col("title_match").isNotNull(), BLOCK_SOFT)
        .otherwise(NONE)
    )
    conflict = (
        F.when(action == BLOCK_HARD, F.col("hash_match"))
        .when(action == REINDEX, F.col("document_id"))
        .when(action == BLOCK_SOFT, F.col("title_match"))
    )
    return decided.select(
        *incoming.columns,
        action.alias("action"),
        conflict.alias("conflicting_document_id"),
    )


def _matchable(incoming: DataFrame, indexed: DataFrame) -> DataFrame:
    """Incoming rows and the indexed documents they can meet, with a node number and keys.

    A key that never matches (null hash, blank title, null call) is a value of the row's own, so
    unmatchable rows neither meet in one task nor count as sharing.
    """
    known = matching_documents(indexed, incoming).withColumn("known", F.lit(True))
    known = materialise(known.withColumn("node", 2 * F.monotonically_increasing_id() + 1))
    new = incoming.withColumns({"known": F.lit(False), "node": 2 * F.col("position").cast("bigint")})
    rows = new.unionByName(known, allowMissingColumns=True)
    own = F.concat(F.lit("\0"), F.col("node").cast("string"))
    title = F.when(~is_blank(F.col("proposal_title")), F.concat("proposal_title", F.lit("\0"), "call_id"))
    return materialise(
        rows.withColumns(
            {"i": F.coalesce("document_id", own), "h": F.coalesce("content_hash", own), "t": F.coalesce(title, own)}
        )
    )


def _thinned(rows: DataFrame, force: bool) -> DataFrame:
    """Rows with ``action`` and ``conflict`` where they are certain whatever happens in between.

    A record stays for good if no other row has its id (nobody re-indexes it) and, with force, nobody of
    its title and call has other bytes (nobody replaces it). Copies behind such a record are decided at
    once, so a key of a third of all rows leaves a few rows to the replay.
    """
    shared_id = rows.groupBy("i").agg(F.count("*").alias("i_n")).filter("i_n > 1")
    rows = rows.join(shared_id, "i", "left")
    stays = F.col("i_n").isNull()
    if force:
        contested = (
            rows.groupBy("t").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
            .filter("n > 1 AND low <> high").select("t", F.lit(True).alias("contested"))
        )
        rows = rows.join(contested, "t", "left")
        stays = stays & F.col("contested").isNull()
    rows = rows.withColumn("stays", stays)

    def summary(key: str, calm: Column) -> DataFrame:
        here = F.when(~F.col("known"), F.col("node"))
        return (
            rows.groupBy(key).agg(
                F.count("*").alias(f"{key}_n"), F.count_if("known").alias(f"{key}_known"), F.min(here).alias(f"{key}_first"),
                F.bool_and(calm).alias(f"{key}_calm"), F.min(F.when(F.col("known"), F.col("document_id"))).alias(f"{key}_owner"),
            ).filter(F.col(f"{key}_n") > 1)
        )

    rows = rows.join(summary("h", ~F.col("known") | F.col("stays")), "h", "left")
    rows = rows.join(summary("t", F.col("i_n").isNull()), "t", "left")

    def leads(key: str) -> Column:
        return F.col(f"{key}_n").isNull() | ((F.col(f"{key}_known") == 0) & (F.col("node") == F.col(f"{key}_first")))

    certain = ~F.col("known") & F.col("stays") & leads("h") & leads("t")
    rows = materialise(rows.withColumn("certain", certain))
    for key in ("h", "t"):
        first = rows.filter(F.col("certain") & F.col(f"{key}_n").isNotNull()).select(
            key, F.col("node").alias(f"{key}_winner"), F.col("document_id").alias(f"{key}_winner_id")
        )
        rows = rows.join(first, key, "left")

    def behind(key: str) -> Column:
        return F.when((F.col(f"{key}_known") > 0) & F.col(f"{key}_calm"), F.col(f"{key}_owner")).when(
            F.col(f"{key}_winner") != F.col("node"), F.col(f"{key}_winner_id")
        )

    lone = F.col("i_n").isNull() & F.col("h_n").isNull()
    soft = F.when(lone & F.col("t_calm"), behind("t")) if not force else F.lit(None).cast("string")
    action = (
        F.when(F.col("known"), None).when(behind("h").isNotNull(), BLOCK_HARD).when(soft.isNotNull(), BLOCK_SOFT)
        .when(lone & F.col("t_n").isNull(), NONE)
    )
    conflict = F.when(action == BLOCK_HARD, behind("h")).when(action == BLOCK_SOFT, soft)
    return rows.withColumns({"action": action, "conflict": conflict})


class _Index:
    """The records of one component while its rows are replayed."""

    def __init__(self):
        self.records: dict[str, list] = defaultdict(list)
        self.by_hash: dict[str, list] = defaultdict(list)
        self.by_title: dict[str, list] = defaultdict(list)

    def add(self, doc: str, digest: str, title: str, position: int | None) -> None:
        self.records[doc].append((digest, title, position))
        heapq.heappush(self.by_hash[digest], doc)
        heapq.heappush(self.by_title[title], doc)

    def owner(self, key: str, place: int) -> str | None:
        """The least id that holds a hash (place 0) or title (place 1)."""
        held = (self.by_hash, self.by_title)[place].get(key, [])
        while held and all(r[place] != key for r in self.records.get(held[0], ())):
            heapq.heappop(held)  # freed
        return held[0] if held else None

    def decide(self, position: int, doc: str, digest: str, title: str, force: bool) -> tuple:
        """(action, conflicting id, position of the batch's record it replaces)."""
        action, conflict = BLOCK_HARD, self.owner(digest, 0)
        if conflict is None:
            if self.records.get(doc):
                action, conflict = REINDEX, doc
            else:
                conflict = self.owner(title, 1)
                action = NONE if conflict is None else BLOCK_SOFT
        replaced = None
        if action in (NONE, REINDEX) or (force and action == BLOCK_SOFT):
            gone = self.records.pop(conflict, []) if conflict is not None else []
            replaced = next((p for _, _, p in gone if p is not None), None)
            self.add(doc, digest, title, position)
        return action, conflict, replaced


def _replay(batches, force: bool):
    component, index = None, _Index()
    for batch in batches:
        out = []
        columns = ("component", "known", "position", "i", "h", "t")
        for group, known, position, *keys in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if group != component:
                component, index = group, _Index()
            if known:
                index.add(*keys, None)
            else:
                out.append(index.decide(position, *keys, force))
        new = batch.filter(pc.invert(batch.column("known"))).drop_columns(["component", "known", "i", "h", "t"])
        decided = zip(*out, strict=True) if out else ((), (), ())
        for name, kind, values in zip(_DECIDED, (pa.string(), pa.string(), pa.int64()), decided, strict=True):
            new = new.append_column(name, pa.array(values, kind))
        yield new


_DECIDED = ("action", "conflicting_document_id", "replaced_position")


def decide_batch(incoming: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Decisions for a batch taken strictly one by one in ``position`` order (unique bigints).

    Each document sees the index as the ones before it left it: admitted records count, a record that
    is re-indexed or, with ``force``, replaced is gone and its keys are free. The smallest id among the
    records that conflict is reported; ``replaced_position`` is the batch's own record that made way.

    What nothing in between can change is decided in bulk first. The rest falls into components over
    shared hashes, ids and titles, which do not see each other; each is replayed in order, as a stream
    that holds its keys only.
    """
    rows = materialise(_thinned(_matchable(incoming, indexed), force))
    early = rows.filter("action IS NOT NULL").select(
        *incoming.columns, "action", F.col("conflict").alias("conflicting_document_id"),
        F.lit(None).cast("bigint").alias("replaced_position"),
    )
    rest = rows.filter("action IS NULL").select(*incoming.columns, "known", "node", "i", "h", "t")
    links = materialise(key_links(rest, "node", ("i", "h", "t")))
    found = rest.withColumn("component", F.col("node"))
    if not links.isEmpty():
        groups = connected(links)
        found = rest.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ordered = found.repartition("component").sortWithinPartitions("component", F.desc("known"), "position").drop("node")
    fields = StructType(
        incoming.schema.fields + [StructField(n, t) for n, t in zip(_DECIDED, (StringType(), StringType(), LongType()), strict=True)]
    )
    late = ordered.mapInArrow(lambda batches: _replay(batches, force), fields)
    return early.unionByName(late)


def admission(decisions: DataFrame, force: bool = False) -> DataFrame:
    """Which documents enter the index, and which indexed document each one replaces."""
    action = F.col("action")
    admitted = action.isin(NONE, REINDEX) | (F.lit(force) & (action == BLOCK_SOFT))
    outcome = (
        F.when(~admitted, "skipped").when(action == NONE, "added").otherwise("reindexed")
    )
    return decisions.withColumns(
        {
            "outcome": outcome,
            "replaced_document_id": F.when(
                outcome == "reindexed", F.col("conflicting_document_id")
            ),
        }
    )


def survivors(admitted: DataFrame) -> DataFrame:
    """``stays``: whether the record of an admitted document is still there when the batch is over."""
    admitted = materialise(admitted)
    gone = admitted.filter("replaced_position IS NOT NULL").select(
        F.col("replaced_position").alias("position"), F.lit(True).alias("gone")
    )
    kept = (F.col("outcome") != "skipped") & F.col("gone").isNull()
    return admitted.join(gone, "position", "left").withColumn("stays", kept).drop("gone")


def batch_summary(admitted: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Documents and chunks per outcome (added, reindexed, skipped).

    ``chunk_counts`` is (position, chunk_count) of the presented documents.
    """
    stored = F.when(F.col("outcome") == "skipped", 0).otherwise(
        F.coalesce("chunk_count", F.lit(0))
    )
    return (
        admitted.join(chunk_counts, "position", "left")
        .groupBy("outcome")
        .agg(F.count("*").alias("documents"), F.sum(stored).cast("bigint").alias("chunks"))
    )
