"""What a Python worker holds follows neither the texts of a batch nor those it has seen before."""

import itertools
import string
import tracemalloc

import pyarrow as pa
import pytest

import corpus_pipeline
from folioflow.llm import bpe, shared
from folioflow.session import BATCH_BYTES, BATCH_SETTING


@pytest.fixture
def unbounded(spark):
    """The session without a bound of its own, and again as it was."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING)
    yield spark
    if before is None:
        spark.conf.unset(BATCH_SETTING)
    else:
        spark.conf.set(BATCH_SETTING, before)


def test_batches_of_a_pipeline_stage_end_by_bytes(unbounded):
    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "n"])

    docs = unbounded.range(0, 6000, 1, 1).selectExpr(
        "id AS doc_id", "repeat('word ', 800) AS text", "'en' AS lang", "'s' AS source", "4000L AS n_chars"
    )
    dict(corpus_pipeline.STAGES)["bpe"](unbounded, docs, "")
    sizes = docs.mapInArrow(measure, "bytes bigint, n bigint").collect()
    assert sum(r["n"] for r in sizes) == 6000
    assert max(r["bytes"] for r in sizes) <= BATCH_BYTES + 5000
    unbounded.conf.set(BATCH_SETTING, "12345678")
    dict(corpus_pipeline.STAGES)["bpe"](unbounded, docs, "")
    assert unbounded.conf.get(BATCH_SETTING) == "12345678"  # a given bound stays


def test_a_long_text_leaves_nothing_with_the_worker():
    words, counts = shared.word_hashes(pa.array(["many words " * 500_000, "many words"]))
    assert counts.tolist() == [1_000_000, 2]
    assert words[:2].tolist() == words[-2:].tolist()
    shared._powers.cache_clear()
    tracemalloc.start()
    shared.word_hashes(pa.array(["many words " * 500_000]))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1 << 20


def test_the_cache_of_pre_tokens_is_bounded_and_changes_no_id():
    tokens = bpe.read_vocabulary()
    table = bpe.PerfectHash(tokens)
    used, fresh = bpe.Encoder(tokens, table), bpe.Encoder(tokens, table)
    names = ["".join(x) for x in itertools.product(string.ascii_lowercase, repeat=4)][: 300_000]
    for start in range(0, len(names), 10_000):
        used.encode_all([" ".join(names[start : start + 10_000])])
    assert len(used.known) + len(used.older) <= 210_000
    again = [" ".join(names[i : i + 40]) for i in range(0, len(names), 9_973)]
    assert used.encode_all(again) == [fresh.encode(t) for t in again]


def test_smaller_passes_give_the_same_pieces_in_order():
    texts = ["", None, "x" * 70, "é" * 40, "y"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for size in (1, 64, 100, shared.PASS_BYTES):
        pieces = list(shared.text_chunks([batch], size=size))
        assert [t for p in pieces for t in p.column("text").to_pylist()] == texts
        assert all(p.num_rows == 1 or len("".join(t or "" for t in p.column("text").to_pylist()).encode()) <= size for p in pieces)
