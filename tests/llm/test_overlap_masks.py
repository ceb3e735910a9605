"""No window that agrees in enough words is missed, whatever words differ and wherever it lies."""

from __future__ import annotations

import itertools

import pytest

from folioflow.llm import decontamination

SCHEMA = "doc_id bigint, text string"


def cases(size):
    """(text, item) by document: item windows of `size` words with as many changed words as may differ."""
    item = [f"i{size}w{n}" for n in range(size)]
    differ = size - -(-size * decontamination.PERCENT // 100)
    for wrong in itertools.combinations(range(size), differ):
        changed = [f"x{n}" if n in wrong else w for n, w in enumerate(item)]
        yield " ".join(["before", "it", *changed]), " ".join(item)


def missed(spark, sizes):
    texts, items, expected = [], {}, set()
    for size in sizes:
        for text, item in cases(size):
            texts.append((len(texts), text))
            expected.add((len(texts) - 1, size))
            items[size] = item
    documents = spark.createDataFrame(texts, SCHEMA).repartition(4)
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    out = decontamination.overlaps(documents, benchmark).collect()
    assert all(r["start_word"] == 2 for r in out)
    return expected - {(r["doc_id"], r["item_id"]) for r in out}


def test_items_of_the_longest_mask_and_more_are_found_with_changed_words(spark):
    assert missed(spark, range(10, 17)) == set()


@pytest.mark.parametrize("before", [0, 1])
def test_windows_at_the_end_of_a_longer_item_are_found(spark, before):
    item = [f"w{n}" for n in range(17)]
    texts = [
        (n, " ".join(f"x{i}" if i in wrong else w for i, w in enumerate(item) if before <= i < 16 + before))
        for n, wrong in enumerate(itertools.combinations(range(before, 16 + before), 3))
    ]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    out = decontamination.overlaps(spark.createDataFrame(texts, SCHEMA).repartition(4), benchmark)
    assert out.select("doc_id").distinct().count() == len(texts) == 560


def test_items_shorter_than_the_masks_are_found(spark):
    assert missed(spark, range(1, 10)) == set()
    benchmark = spark.createDataFrame([(4, "what is it made"), (6, "who wrote this very long book"), (0, "?")], "item_id bigint, text string")
    texts = [(1, "What is it, made of"), (2, "what is it not"), (3, "who read this very long book"), (4, "who read this very thin book"), (5, None)]
    out = decontamination.overlaps(spark.createDataFrame(texts, SCHEMA), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["agreeing"]) for r in out) == [(1, 4, 4), (3, 6, 5)]
