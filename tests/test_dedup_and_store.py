from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from folioflow.operators import dedup, groups, maintenance
from folioflow.operators.lineage import materialise
from folioflow.sources.chunk_table import ChunkTable

ROW = "position bigint, document_id string, content_hash string, proposal_title string, call_id string"
INDEXED = "document_id string, content_hash string, proposal_title string, call_id string"


def _one_by_one(incoming, indexed, force=False):
    """The batch rule stated plainly: a loop over documents with an index that really deletes."""
    live = {d: (h, t, c, None) for d, h, t, c in indexed}
    out = {}
    for position, doc, digest, title, call in sorted(incoming):
        named = title is not None and title.strip() and call is not None
        hits = [d for d, r in live.items() if digest is not None and r[0] == digest]
        same = [d for d, r in live.items() if named and r[1:3] == (title, call)]
        if hits:
            out[position] = ("block_hard", min(hits), None)
            continue
        if doc in live:
            action, conflict = "reindex", doc
        elif same:
            action, conflict = "block_soft", min(same)
        else:
            action, conflict = "none", None
        replaced = None
        if action != "block_soft" or force:
            if conflict:
                replaced = live.pop(conflict)[3]
            live[doc] = (digest, title, call, position)
        out[position] = (action, conflict, replaced)
    return out


def _decided(spark, incoming, indexed, force=False):
    got = dedup.decide_batch(spark.createDataFrame(incoming, ROW), spark.createDataFrame(indexed, INDEXED), force)
    assert got.columns == [*ROW.replace(" bigint", "").replace(" string", "").split(", "), "action", "conflicting_document_id", "replaced_position"]
    return {r["position"]: (r["action"], r["conflicting_document_id"], r["replaced_position"]) for r in got.collect()}


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_batch_decisions_equal_the_loop(spark, seed, force):
    rng = random.Random(seed)

    def pick(kind, size):
        # a third of all rows share one key
        return f"{kind}{0 if rng.random() < 0.34 else rng.randrange(size)}"

    indexed = [(f"d{i}", f"h{rng.randrange(40)}", f"t{rng.randrange(40)}", "C") for i in range(8)]
    incoming = []
    for p in range(-20, 100):
        digest = None if rng.random() < 0.1 else pick("h", 40 + 40 * seed)
        title = rng.choice([None, "  ", pick("t", 30), pick("t", 30)])
        ident = pick("d", 30) if rng.random() < 0.3 else f"own{p}"
        incoming.append((p, ident, digest, title, rng.choice(["C", "C", "E", None])))
    assert _decided(spark, incoming, indexed, force) == _one_by_one(incoming, indexed, force)


def test_copies_behind_a_record_that_stays_are_not_replayed(spark, monkeypatch):
    rows = [(p, f"d{p}", "same", f"t{p}", "C") for p in range(200)]
    rows += [(1000 + p, f"e{p}", f"u{p}", "one title", "C") for p in range(200)]
    rows += [(2000 + p, f"f{p}", None, None, "C") for p in range(200)]
    for force in (False, True):
        given = dedup._matchable(spark.createDataFrame(rows, ROW), spark.createDataFrame([], INDEXED))
        left = dedup._thinned(given, force).filter("action IS NULL")
        # with force every row of the one title replaces the one before
        assert left.count() == (201 if force else 2)
        assert _decided(spark, rows, [], force) == _one_by_one(rows, [], force)


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    rounds = []
    real = groups.materialise
    monkeypatch.setattr(groups, "materialise", lambda df: rounds.append(1) or real(df))
    # each document takes the id of the one before and the title of the next
    rows = [(p, f"d{p // 2}", f"h{p}", f"t{(p + 1) // 2}", "C") for p in range(10_000)]
    assert _decided(spark, rows, []) == _one_by_one(rows, [])
    assert len(rounds) < 25


def test_decision_precedence(spark):
    indexed = spark.createDataFrame([("a", "h1", "T", "C"), ("b", "h2", " ", "C")], INDEXED)
    rows = [
        (1, "a", "h1", "T", "C"),
        (2, "a", "h9", "T", "C"),
        (3, "x", "h9", "T", "C"),
        (4, "x", None, "T", "other"),
        (5, "y", None, " ", "C"),
    ]
    got = dedup.decide_duplicates(spark.createDataFrame(rows, ROW), indexed).orderBy("position").collect()
    assert [(r["action"], r["conflicting_document_id"]) for r in got] == [
        ("block_hard", "a"),
        ("reindex", "a"),
        ("block_soft", "a"),
        ("none", None),
        ("none", None),
    ]


CHUNK = "chunk_id string, document_id string, text string"


def _content(table):
    return sorted((r["chunk_id"], r["text"]) for r in table.read().collect())


def test_table_upsert_reindex_delete_drop(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    other = ChunkTable(spark, str(tmp_path / "t"), "other")
    assert table.count() == 0
    rows = [("a1", "a", "1"), ("a2", "a", "2"), ("b1", "b", "3")]
    table.upsert(spark.createDataFrame(rows, CHUNK))
    other.upsert(spark.createDataFrame([("a1", "a", "other")], CHUNK))
    table.upsert(spark.createDataFrame(rows, CHUNK))
    assert table.count() == 3
    table.upsert(spark.createDataFrame([("a2", "a", "2b"), ("c1", "c", "4")], CHUNK))
    assert _content(table) == [("a1", "1"), ("a2", "2b"), ("b1", "3"), ("c1", "4")]
    # a re-index leaves no orphan behind
    table.replace_documents(
        spark.createDataFrame([("a",)], "document_id string"),
        spark.createDataFrame([("a1", "a", "new")], CHUNK),
    )
    assert _content(table) == [("a1", "new"), ("b1", "3"), ("c1", "4")]
    table.delete_documents(spark.createDataFrame([("b",)], "document_id string"))
    assert _content(table) == [("a1", "new"), ("c1", "4")]
    table.compact()
    assert _content(table) == [("a1", "new"), ("c1", "4")]
    assert len(table._live_batches()) == 1
    table.drop()
    assert table.count() == 0
    assert _content(other) == [("a1", "other")]
    table.upsert(spark.createDataFrame([("z", "z", "9")], CHUNK))
    assert _content(table) == [("z", "9")]


def test_uncommitted_version_is_invisible_and_a_stream_batch_is_stored_once(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    table.upsert(spark.createDataFrame([("a", "a", "1")], CHUNK))
    # a writer that died before its commit
    table._write(spark.createDataFrame([("a", "a", "broken")], CHUNK), "chunks", 1)
    assert _content(table) == [("a", "1")]
    again = spark.createDataFrame([("a", "a", "2")], CHUNK)
    assert table.upsert(again, ("stream", 0)) == 1
    table.upsert(spark.createDataFrame([("a", "a", "tried again")], CHUNK), ("stream", 0))
    assert _content(table) == [("a", "2")]
    # another stream, or another batch, is no second try
    table.compact()
    table.upsert(spark.createDataFrame([("b", "b", "3")], CHUNK), ("stream", 1))
    table.upsert(spark.createDataFrame([("c", "c", "4")], CHUNK), ("new stream", 0))
    assert _content(table) == [("a", "2"), ("b", "3"), ("c", "4")]
    # a version number that is taken raises
    with pytest.raises(AnalysisException):
        table._commit(0, "write")


def test_collections_with_like_names_are_apart(spark, tmp_path):
    names = ("1", "01", "1.0", "a/b", "a%2Fb")
    for name in names:
        ChunkTable(spark, str(tmp_path / "t"), name).upsert(spark.createDataFrame([("a", "a", name)], CHUNK))
    for name in names:
        assert _content(ChunkTable(spark, str(tmp_path / "t"), name)) == [("a", name)]


def test_checkpoints_need_a_named_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, *a: None)
    with pytest.raises(ValueError):
        materialise(spark.range(1))


def test_summary_counts(spark):
    decisions = spark.createDataFrame(
        [(1, "none", None), (2, "reindex", "d"), (3, "block_soft", "e"), (4, "block_hard", "f")],
        "position int, action string, conflicting_document_id string",
    )
    counts = spark.createDataFrame([(1, 3), (2, 4), (3, 5)], "position int, chunk_count int")

    def run(force):
        rows = dedup.batch_summary(dedup.admission(decisions, force), counts).collect()
        return {r["outcome"]: (r["documents"], r["chunks"]) for r in rows}

    assert run(False) == {"added": (1, 3), "reindexed": (1, 4), "skipped": (2, 0)}
    assert run(True) == {"added": (1, 3), "reindexed": (2, 9), "skipped": (1, 0)}


def test_no_text_is_exchanged_by_a_reindex(spark, capsys):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 7}", "text") for i in range(50)], CHUNK)
    replaced = spark.createDataFrame([("d1",), ("d1",), ("d5",)], "document_id string")
    new = spark.createDataFrame([("c0", "d1", "new"), ("n1", "d5", "new")], CHUNK)
    out = maintenance.reindex(chunks, replaced, new)
    ids = {r["chunk_id"]: r["text"] for r in out.collect()}
    assert ids == {**{f"c{i}": "text" for i in range(1, 50) if i % 7 not in (1, 5)}, "c0": "new", "n1": "new"}
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") >= 2
