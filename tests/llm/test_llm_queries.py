"""Registered queries against their SQL twins, and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import tiktoken
from brute import deduplicated, jaccard_components, overlapping
from compare import differences

from folioflow.llm import bpe
from folioflow.llm.quality import op2_quality
from folioflow.llm.registry import ORACLES, QUERIES
from folioflow.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def twin():
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, twin, name):
    assert differences(QUERIES[name](spark, SF), twin, ORACLES[name]) == []


def test_pipeline_equals_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    good = {r["doc_id"] for r in op2_quality(spark, SF).collect() if r["predicted"]}
    assert 0.7 < len(good) / len(texts) < 1
    texts = deduplicated({i: t for i, t in texts.items() if i in good})
    groups = jaccard_components(texts)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    dirty = {i for i, _ in overlapping(texts, items)}
    ranks = {t: i for i, t in enumerate(bpe.read_vocabulary())}
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, text in texts.items():
        if i not in dirty:
            ids = np.array(encoding.encode_ordinary(text), "<u4")
            digests = (hashlib.sha256(b).hexdigest() for b in (ids.tobytes(), text.encode()))
            expected.append((i, len(ids), *digests))
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def test_stages_take_odd_rows_and_empty_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "text " * 60, "en", "s", 300), (2, "", "en", "s", 0)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        scratch = Scratch(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.columns == docs.columns
                docs = scratch.save(out, name)
        assert out.columns[0] == "doc_id"
        # rows without an id or a text are no reason to drop one; equal ids stay together
        assert out.count() == docs.count() <= len(rows)
