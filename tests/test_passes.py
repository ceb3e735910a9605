"""How often a search reads its tables, and what its embedding holds of a batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions.ids import chunk_id, document_of_chunk
from folioflow.operators import embedding, similarity
from folioflow.plans import views

QUERY = "query_id bigint, n int, embedding array<float>, kind string"
CHUNK = "chunk_id string, embedding array<float>, kind string"


def _tables(spark, seed=5, hot=0):
    rng = random.Random(seed)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    one = vector()
    rows = [(f"c{rng.random():.9f}", one if i < hot else vector(), "ab"[i % 2]) for i in range(3000)]
    asked = [(q, [0, 1, 7, 600][q % 4], one if q == 3 else vector(), [None, "a", "b", "none"][q // 4 % 4]) for q in range(23)]
    return spark.createDataFrame(rows, CHUNK).repartition(3), spark.createDataFrame(asked, QUERY), rows, asked


def _found(chunks, queries, **how):
    got = similarity.top_n(chunks, queries, filter_columns=("kind",), carry=("kind",), **how).collect()
    return sorted((r["query_id"], -r["score"], r["chunk_id"], r["kind"]) for r in got)


def _plain(rows, asked):
    out = []
    for q, n, v, wanted in asked:
        a = np.array(v, dtype=np.float32).astype(float)
        b = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
        scores = np.round(b @ a / np.linalg.norm(a) / np.linalg.norm(b, axis=1), 12) + 0.0
        ranked = sorted((-s, i, k) for s, (i, _, k) in zip(scores.tolist(), rows) if wanted in (None, k))
        out += [(q, s, i, k) for s, i, k in ranked[:n]]
    return sorted(out)


def test_small_blocks_share_a_pass(spark, monkeypatch):
    """the passes over the table are counted by bytes, not by the size of a block."""
    chunks, queries, rows, asked = _tables(spark)
    passes, search = [], similarity._search
    monkeypatch.setattr(similarity, "_search", lambda *a: passes.append(len(a[1])) or search(*a))
    assert _found(chunks, queries, block_queries=2) == _plain(rows, asked)
    assert passes == [23]
    assert _found(chunks, queries, block_queries=2, pass_queries=9, strides=(2,)) == _plain(rows, asked)
    assert sum(passes[1:]) == 23 and len(passes) >= 4


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_merges_are_exact_with_many_ties(spark, monkeypatch, limit):
    """half of the rows are copies; merging after few or after many hits gives the same rows."""
    chunks, queries, rows, asked = _tables(spark, hot=1500)
    best = similarity._Best(similarity._query_block(queries.withColumnRenamed("query_id", "variant").toPandas(), ("kind",), 5), ("kind",))
    monkeypatch.setattr(similarity, "_WAITING", limit)
    monkeypatch.setattr(similarity, "_SAMPLE", 16)
    for at in range(0, len(rows), 700):
        part = rows[at : at + 700]
        best.add(
            np.array([r[0] for r in part], dtype=object),
            pa.array([r[1] for r in part], pa.list_(pa.float32())),
            {"kind": np.array([r[2] for r in part], dtype=object)},
        )
    t = best.table()
    assert sorted(zip(t["variant"], [-s for s in t["score"]], t["id"], t["kind"])) == _plain(rows, asked)


def test_a_joined_table_is_computed_once(spark, tmp_path):
    """F2 to F8: a join's estimated size is no number of tasks, so small tables get no rounds for bounds."""
    chunks, queries, *_ = _tables(spark)
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks.select("chunk_id", F.lit(1).alias("label")).write.parquet(str(tmp_path / "labels"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(v):
        seen.add(1)
        return v

    read = spark.read.parquet
    joined = read(str(tmp_path / "chunks")).join(read(str(tmp_path / "labels")), "chunk_id", "left")
    for _ in range(3):  # as deep plans have it
        joined = joined.join(read(str(tmp_path / "labels")).withColumnRenamed("label", "more").drop("more"), "chunk_id", "left")
    side = joined.withColumn("embedding", counted("embedding"))
    similarity.top_n(side, queries, filter_columns=("kind",)).collect()
    assert seen.value == 3000


def test_rounds_follow_what_tasks_may_send():
    assert similarity._strides(47, 7000) == []  # 6 GB of files
    assert similarity._strides(100_000, 7000) == [16**2, 16]
    assert similarity._strides(17, similarity.SENT_ROWS) == [16]


def test_document_of_chunk(one):
    for document in ("doc_1", "a::b::0123456789ab::000001", "x\ny"):
        assert one(document_of_chunk(chunk_id(F.col("d"), F.lit("h"), F.lit(3))), "d string", document) == document
    assert one(document_of_chunk(chunk_id(F.col("d"), F.lit("h"), F.lit(3))), "d string", None) is None


def test_only_wanted_documents_are_cut_into_chunks(spark):
    """F5, F7 and F8: the texts of the citations come from the documents that hold a result."""
    sf = "/root/testdata/sf0.001"
    wanted = spark.createDataFrame([("doc_3",), ("doc_7",)], "document_id string")
    got = views.chunks(spark, sf, wanted)
    assert {r["document_id"] for r in got.select("document_id").distinct().collect()} == {"doc_3", "doc_7"}
    whole = views.chunks(spark, sf).where("document_id IN ('doc_3', 'doc_7')")
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0


@pytest.mark.parametrize("kind", ["hash", "model"])
def test_few_texts_of_a_batch_are_objects_at_once(kind):
    """a worker's memory follows the vectors of a batch, not its texts."""
    words = [" ".join(f"w{(i * j) % 997}" for j in range(700)) for i in range(4000)]
    texts = pa.array([None if i % 7 == 0 else w for i, w in enumerate(words)])
    del words
    dim = 16
    if kind == "hash":
        model = embedding._hashed(embedding._token_buckets(dim), dim)
    else:
        model = embedding._checked(lambda batch: [[len(t)] * dim for t in batch], dim)
    tracemalloc.start()
    vectors = embedding._vectors(texts, dim, 64, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert vectors.null_count == texts.null_count and len(vectors) == 4000
    assert vectors[1].as_py() is not None and len(vectors[1].as_py()) == dim
    assert texts.nbytes > 10 << 20 and peak < 4 << 20
