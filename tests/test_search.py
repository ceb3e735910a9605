from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators import embedding, retrieval, similarity
from folioflow.operators.retrieval import RetrievalPolicy, rank_by_policy, retrieve


def _vector(text, dim=384):
    counts = [0] * dim
    for token in text.lower().split():
        counts[int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big") % dim] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm if norm else 0.0 for c in counts]


def test_hash_embedding_equals_plain_rule(spark):
    texts = ["Excellence excellence Methods", "", " a  b ", "É é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", embedding.hash_embedding(F.col("t")).alias("v")).collect():
        assert row["v"] == pytest.approx(_vector(row["t"]), abs=1e-6)


def test_model_embedding_checks_width(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    wrong = embedding.model_embedding(F.col("t"), lambda: (lambda b: [[1.0]] * len(b)), dim=2)
    with pytest.raises(Exception, match="expected 2"):
        df.select(wrong).collect()


def test_embed_missing_keeps_supplied(spark):
    df = spark.createDataFrame(
        [("a", "x", [1.0, 0.0]), ("b", "y", None)], "chunk_id string, text string, embedding array<float>"
    )
    rows = {r["chunk_id"]: r["embedding"] for r in embedding.embed_missing(df).collect()}
    assert rows["a"] == [1.0, 0.0]
    assert len(rows["b"]) == 384


def _best(chunks, query, n, wanted):
    def score(v):
        a, b = np.array(v, dtype=np.float32).astype(float), np.array(query, dtype=np.float32).astype(float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 12) + 0.0 if size else 0.0

    rows = [(-score(v), i) for i, v, kind in chunks if wanted is None or kind == wanted]
    return [(i, -s) for s, i in sorted(rows)[:n]]


@pytest.mark.parametrize("route", [{}, {"block_queries": 3}, {"strides": (4, 2)}, {"block_queries": 2, "strides": (2,)}])
def test_top_n_is_exact_under_copies(spark, route):
    """A third of all rows are copies of one vector, so every cut runs through a tie."""
    rng = random.Random(3)
    hot = [rng.uniform(-1, 1) for _ in range(8)]
    chunks = []
    for i in range(240):
        v = hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(8)]
        chunks.append((f"c{rng.random():.9f}", v if i != 7 else [0.0] * 8, "ab"[i % 2]))
    queries = [(q, 5 + q, [rng.uniform(-1, 1) for _ in range(8)] if q else hot, [None, "a", "b"][q % 3]) for q in range(7)]
    chunk_df = spark.createDataFrame(chunks, "chunk_id string, embedding array<float>, kind string").repartition(5)
    query_df = spark.createDataFrame(queries, "query_id bigint, n int, embedding array<float>, kind string")
    got = similarity.top_n(chunk_df, query_df, filter_columns=("kind",), carry=("kind",), **route).collect()
    for q, n, v, wanted in queries:
        mine = sorted(((-r["score"], r["chunk_id"]) for r in got if r["query_id"] == q))
        assert [(i, -s) for s, i in mine] == _best(chunks, v, n, wanted)
        assert all(r["kind"] == wanted for r in got if r["query_id"] == q and wanted)


def test_top_n_without_queries_or_chunks(spark):
    chunks = spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, 2, [1.0])], "query_id bigint, n int, embedding array<float>")
    assert similarity.top_n(chunks, queries.limit(0)).count() == 0
    assert similarity.top_n(chunks.limit(0), queries).count() == 0


SCORED = (
    "query_id bigint, top_k int, lessons boolean, chunk_id string, source_status string, "
    "score double, fell_back boolean"
)


def _ranked(spark, rows, policy, top_k=10, lessons=False):
    df = spark.createDataFrame([(1, top_k, lessons, c, s, x, False) for c, s, x in rows], SCORED)
    return [(r["chunk_id"], r["policy_reason"]) for r in rank_by_policy(df, policy).orderBy("rank").collect()]


def test_status_priority_leads_over_score(spark):
    rows = [("a", "unknown", 0.9), ("b", "rejected", 0.8), ("c", "funded", 0.4), ("d", "esr_note", 0.95)]
    got = _ranked(spark, rows, RetrievalPolicy(max_rejected_fraction=1.0))
    assert got == [
        ("c", "funded_primary"),
        ("b", "rejected_threshold_met"),
        ("d", "esr_advisory"),
        ("a", "unknown_low_confidence"),
    ]
    by_score = _ranked(spark, rows, RetrievalPolicy(funded_first=False, include_esr=False))
    assert [c for c, _ in by_score] == ["a", "b", "c"]


def test_rejected_cap_skips_but_goes_on(spark):
    rows = [("r1", "rejected", 0.9), ("r2", "rejected", 0.8), ("r3", "rejected", 0.7), ("u", "unknown", 0.6)]
    assert [c for c, _ in _ranked(spark, rows, RetrievalPolicy(), top_k=5)] == ["r1", "r2", "u"]
    lessons = _ranked(spark, rows, RetrievalPolicy(), top_k=5, lessons=True)
    assert [r for _, r in lessons][:3] == ["lessons_learned_mode"] * 3


def test_rejected_cap_floors_in_double(spark):
    rows = [(f"r{i:03d}", "rejected", 0.9) for i in range(40)]
    assert len(_ranked(spark, rows, RetrievalPolicy(max_rejected_fraction=0.29), top_k=100)) == 28


def test_lessons_threshold_is_shifted_and_clamped(spark):
    rows = [("r", "rejected", 0.05), ("f", "funded", 0.05)]
    policy = RetrievalPolicy(rejected_threshold_offset=-0.9)
    assert [c for c, _ in _ranked(spark, rows, policy, lessons=True)] == ["r"]
    assert _ranked(spark, rows, policy) == []


REQUEST = (
    "query_id bigint, query string, top_k int, programme string, section_type string, "
    "source_status string, lessons_learned boolean, section_type_fallback boolean"
)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        ("c1", "deep learning methods", "cef", "other", "funded"),
        ("c2", "deep learning risks", "cef", "other", "rejected"),
        ("c3", "deep sea budget", "other", "budget", "funded"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, text string, programme string, section_type string, source_status string")
    return df.withColumn("embedding", embedding.hash_embedding(F.col("text")))


def _ask(spark, corpus, *rows, policy=RetrievalPolicy()):
    got = retrieve(corpus, spark.createDataFrame(list(rows), REQUEST), policy)
    return [(r["query_id"], r["chunk_id"], r["policy_reason"]) for r in got.orderBy("query_id", "rank").collect()]


def test_fallback_is_per_query_and_keeps_programme(spark, corpus):
    got = _ask(
        spark,
        corpus,
        (1, "deep learning", 5, "cef", "ethics", None, None, None),
        (2, "deep learning", 5, "cef", "ethics", None, None, False),
        (3, "deep learning", 5, "cef", "ethics", "funded", None, None),
        (4, "deep learning", 5, None, "budget", None, None, None),
    )
    assert got == [
        (1, "c1", "funded_primary_section_type_fallback"),
        (1, "c2", "rejected_threshold_met_section_type_fallback"),
        (4, "c3", "funded_primary"),
    ]


def test_no_fallback_when_pool_is_only_below_threshold(spark, corpus):
    got = _ask(
        spark,
        corpus,
        (1, "unrelated words", 5, None, "budget", None, None, None),
        policy=RetrievalPolicy(relevance_threshold=0.5),
    )
    assert got == []


def test_pool_is_over_fetched_by_four_up_to_100(spark):
    rows = [(1, "q", k, None, None, None, None, None) for k in (3, 25, 80)]
    df = spark.createDataFrame(rows, REQUEST)
    got = retrieval.resolve_requests(df, RetrievalPolicy()).orderBy("top_k").collect()
    assert [r["n"] for r in got] == [12, 100, 100]


def test_policy_bounds():
    with pytest.raises(ValueError):
        RetrievalPolicy(relevance_threshold=1.5)


def test_filters_shared_by_all_queries_reach_the_scan(spark, corpus, tmp_path, capsys):
    path = str(tmp_path / "chunks")
    corpus.write.parquet(path)
    stored = spark.read.parquet(path)
    asked = [(1, "deep learning", 5, "cef", None, None, None, None), (2, "sea", 5, "other", None, None, None, None)]
    got = retrieve(stored, spark.createDataFrame(asked, REQUEST))
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "In(programme, [cef,other])" in plan
    assert "text" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    assert {r["query_id"] for r in got.collect()} == {1, 2}


def test_top_n_ships_winners_only(spark, capsys):
    """Two salted merges of small rows; the vectors themselves are never exchanged."""
    chunks = spark.createDataFrame([("c", [1.0])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, 2, [1.0])], "query_id bigint, n int, embedding array<float>")
    similarity.top_n(chunks, queries).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("WindowGroupLimit") == 4
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.index("Exchange") < plan.index("MapInArrow")


def test_what_is_shuffled_does_not_grow_with_the_tasks(spark):
    """With a bound from an earlier round a task sends only rows that may win, however many tasks there are."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(6000, 8))
    rows = [(f"c{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = pd.DataFrame({"variant": range(5), "n": [10] * 5, "embedding": [list(v) for v in vectors[:5] + 0.1]})
    out = T._parse_datatype_string("variant bigint, n int, score double, id string")
    sent = {}
    for tasks in (8, 64):
        spread = chunks.repartition(tasks)
        for bounded in (False, True):
            block = similarity._query_block(asked, ())
            if bounded:
                scores = similarity._unit(vectors[::16].astype(np.float32)) @ block.vectors.T
                block.floors[:] = np.sort(scores, axis=0)[-10]
            sent[tasks, bounded] = similarity._scan(spread, block, (), out, 1).count()
    # at most n rows a query and task without bounds; about 16 n rows a query with bounds from every 16th row
    assert sent[64, False] == 5 * 10 * 64 and sent[8, True] <= sent[64, True] < 1.3 * 5 * 10 * 16


@pytest.mark.parametrize("route", [4096, 1])
def test_rows_without_a_usable_vector_are_left_out(spark, route):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [1.0]), ("c", [1.0, 0.0, 0.0]), ("d", None), ("e", [None, 1.0]), ("f", [nan, 1.0]),
            ("g", [inf, 0.0]), ("h", []), ("i", [1.0, 1.0]), ("j", [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(1, 9, [2.0, 0.0])], "query_id bigint, n int, embedding array<float>")
    kwargs = {"block_queries": route}
    if route == 1:
        asked = asked.union(asked.withColumn("query_id", F.lit(2).cast("bigint")))
    found = similarity.top_n(chunks, asked, **kwargs).where("query_id = 1").collect()
    assert sorted((r["chunk_id"], round(r["score"], 3)) for r in found) == [("a", 1.0), ("i", 0.707), ("j", 0.0)]


def test_queries_need_vectors_of_one_width(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    for bad in ([(1, 9, [1.0]), (2, 9, [1.0, 2.0])], [(1, 9, None)], [(1, 9, [float("nan"), 1.0])]):
        with pytest.raises(ValueError):
            similarity.top_n(chunks, spark.createDataFrame(bad, "query_id bigint, n int, embedding array<float>"))
