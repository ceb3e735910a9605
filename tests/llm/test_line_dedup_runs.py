"""Line dedup against all maximal repeated runs, found by comparing every two places."""

from __future__ import annotations

import random
import re

import pytest

from folioflow.llm import line_dedup, shared

SCHEMA = "doc_id bigint, text string"


def without_maximal_runs(texts: dict[int, str], min_words: int = 50) -> dict[int, str]:
    """Texts without the longest common run of each place with any earlier one, if it has enough words."""
    lines = [
        (i, n, x, len(re.findall(r"\S+", x)))
        for i in sorted(texts)
        for n, x in enumerate(texts[i].split("\n"))
        if re.search(r"\S", x)
    ]
    cut = set()
    for p in range(len(lines)):
        for q in range(p):
            n = words = 0
            while (
                p + n < len(lines)
                and lines[p + n][0] == lines[p][0]
                and lines[q + n][0] == lines[q][0]
                and lines[p + n][2] == lines[q + n][2]
            ):
                words += lines[p + n][3]
                n += 1
            if words >= min_words:
                cut.update(x[:2] for x in lines[p : p + n])
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in cut) for i, t in texts.items()}


def line(rng, size):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(size))


def deduplicated(spark, rows):
    documents = spark.createDataFrame(rows, SCHEMA)
    return line_dedup.deduplicated_documents(documents, shared.Scratch(spark)).collect()


def test_the_tail_of_a_repeated_run_is_cut(spark):
    rng = random.Random(1)
    a, b, c, d = (line(rng, n) for n in (60, 3, 5, 4))
    # 3 shares its tail only with 2, which is itself a later copy of 1; 4 goes on alone
    rows = [(1, a), (2, f"{a}\n{b}\n{c}"), (3, f"{a}\n{b}\n\n{c}\n{d}"), (4, f"{a}\n{d}\n{b}")]
    out = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in deduplicated(spark, rows)}
    assert out == {1: (a, 0), 2: (f"{b}\n{c}", 1), 3: (f"\n{d}", 3), 4: (f"{d}\n{b}", 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_all_maximal_runs(spark, seed):
    rng = random.Random(seed)
    pool = [line(rng, n) for n in (1, 1, 1, 2, 3, 5, 9, 20, 30, 60)]
    base = [[rng.choice(pool) for _ in range(rng.randint(5, 70))] for _ in range(4)]
    base.append(["tiny"] * 130)
    texts = {}
    for i in range(24):
        some = rng.choice(base)
        begin = rng.randrange(len(some))
        own = [line(rng, 2)] * rng.randint(0, 2)
        texts[i] = "\n".join([*own, *some[begin : begin + rng.randint(1, 120)], *rng.choice([[], [""], [rng.choice(pool)], [line(rng, 3)]])])
    expected = without_maximal_runs(texts)
    assert {r["doc_id"]: r["text"] for r in deduplicated(spark, list(texts.items()))} == expected


def test_lines_of_equal_rows_count_once(spark):
    rng = random.Random(3)
    text = "\n".join(line(rng, 4) for _ in range(40))
    scratch = shared.Scratch(spark)
    documents = spark.createDataFrame([(1, text), (1, text), (2, line(rng, 70))], SCHEMA)
    assert line_dedup.later_runs(documents, scratch).count() == 0
    assert spark.read.parquet(f"{scratch.folder}/level-0").count() == 0
    rows = [(1, text), (1, text), (2, f"{line(rng, 9)}\n{text}"), (2, f"{line(rng, 8)}\n{text}")]
    out = deduplicated(spark, rows)
    assert sorted((r["doc_id"], r["n_deleted"]) for r in out) == [(1, 0), (1, 0), (2, 40), (2, 40)]
