"""Shingles are counted in passes, so that few tasks need not hold or spill them all at once."""

import random

import pytest
from brute import jaccard_components
from pyspark.sql import functions as F

from folioflow.llm import jaccard, shared


@pytest.fixture
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_task_counts_more_than_its_share_and_the_groups_are_whole(few_tasks, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(0, 120, 4):
        first = [rng.choice(words) for _ in range(60)]
        for j in range(4):
            changed = list(first)
            for _ in range(j):
                changed[rng.randrange(60)] = "new"
            texts[i + j] = " ".join(changed)
    counted, sizes = jaccard._Join.counted, []

    def watched(self, held, source, share, count, name):
        def seen(rows):
            keys = rows.groupBy(F.spark_partition_id().alias("task")).count()
            sizes.append((name, rows.count(), keys.agg(F.max("count")).first()[0] or 0))
            return count(rows)

        return counted(self, held, source, share, seen, name)

    monkeypatch.setattr(jaccard._Join, "counted", watched)
    monkeypatch.setattr(jaccard, "COUNTED", 250)
    docs = few_tasks.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(2)
    found = jaccard.jaccard_groups(docs, shared.Scratch(few_tasks)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == jaccard_components(texts)
    # about 1700 sampled shingles and 6800 of the sets left, for at most two tasks of 250 a pass
    for name in ("sampled", "holders"):
        passes = [(rows, most) for table, rows, most in sizes if table == name]
        assert len(passes) > 2
        assert max(most for _, most in passes) <= 2 * 250
    assert sum(rows for table, rows, _ in sizes if table == "holders") > 10 * 250
