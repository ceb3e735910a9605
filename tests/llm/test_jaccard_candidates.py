"""Which shingle sets the Jaccard join takes as candidates."""

from __future__ import annotations

import random

import pytest
from brute import jaccard_components, shingle_set

from folioflow.llm import jaccard, shared


@pytest.mark.parametrize("rows", [3000, 12000])
def test_passages_shared_by_two_documents_make_no_candidates(spark, rows):
    """Each text has 120 words of its own and shares 40 with the one before and 40 with the one after."""
    words = "transform(sequence(1, {n}), x -> substr(sha2(concat('{kind}', {key}, ' ', x), 256), 1, 12))"
    parts = [
        words.format(n=40, kind="p", key="id"), words.format(n=120, kind="w", key="id"),
        words.format(n=40, kind="p", key=f"(id + 1) % {rows}"),
    ]
    texts = spark.range(rows).selectExpr("id AS doc_id", f"concat_ws(' ', concat({', '.join(parts)})) AS text")
    join = jaccard._Join(texts, shared.Scratch(spark), jaccard.WORDS, jaccard.PERCENT)
    assert join.shared_shingles().count() == 0


def test_small_sets_near_the_threshold_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 70))]
        texts.append(words)
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(len(other)), min(len(other), rng.randint(0, 2))):
                other[at] = rng.choice("abcdx")
            texts.append(other[: len(other) - rng.randint(0, 2)])
    rng.shuffle(texts)
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    expected = jaccard_components(dict(rows))
    assert 20 < sum(expected[i] != i for i in expected) < len(rows) - 20
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    for row in jaccard.jaccard_groups(table, shared.Scratch(spark)).collect():
        i = row["doc_id"]
        assert (row["n_shingles"], row["component_id"]) == (len(shingle_set(dict(rows)[i])), expected[i])
