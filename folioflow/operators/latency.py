"""Latency and throughput roll-ups over measurement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.operators.lineage import materialise


def _ranged_counts(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys…, value, n, part): how often each value occurs, in ranges of keys and values over all tasks."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, *keys, value).withColumn("part", F.spark_partition_id())
    return materialise(ranged)  # a range number must not change when it is read again


def exact_percentile(rows: DataFrame, keys: tuple[str, ...], value: str, percent: int) -> DataFrame:
    """(keys…, percentile): linear interpolation between the two values at the percent's ranks, by whole weights.

    Distributed selection: counts per value lie in ranges, a running total over the ranges (a row a
    range) tells which of them hold the two ranks, and only those are searched. So a group of
    any number of distinct values is never held by one task. Null values do not count.
    """
    counts = _ranged_counts(rows, keys, value)
    whole = Window.partitionBy(*keys)
    ranges = counts.groupBy(*keys, "part").agg(F.sum("n").alias("held")).select(
        *keys, "part",
        (F.sum("held").over(whole.orderBy("part")) - F.col("held")).alias("before"),
        "held",
        ((F.sum("held").over(whole) - 1) * percent).alias("rank"),  # in hundredths
    )
    weight = F.col("rank") % 100
    low = F.floor(F.col("rank") / 100) + 1
    high = low + F.when(weight > 0, 1).otherwise(0)
    holds = [(F.col("before") < r) & (r <= F.col("before") + F.col("held")) for r in (low, high)]
    asked = ranges.filter(holds[0] | holds[1])
    running = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value))
    found = counts.join(asked, [*keys, "part"]).withColumn("upto", running)
    ends = found.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") >= low, F.col(value))).alias("low"),
        F.min(F.when(F.col("upto") >= high, F.col(value))).alias("high"),
        F.first("rank").alias("rank"),
    )
    between = (F.col("low") * (100 - weight) + F.col("high") * weight) / 100
    return ends.select(*keys, between.cast("double").alias("percentile"))


def latency_rollup(measurements: DataFrame, *keys: str) -> DataFrame:
    """Per key: count, min, mean, p95 (rounded half to even) and max of ``elapsed_ms``, mean ``result_count``."""
    p95 = exact_percentile(measurements, keys, "elapsed_ms", 95)
    totals = measurements.groupBy(*keys).agg(
        F.count("*").alias("query_count"),
        F.min("elapsed_ms").alias("elapsed_ms_min"),
        F.avg("elapsed_ms").alias("elapsed_ms_avg"),
        F.max("elapsed_ms").alias("elapsed_ms_max"),
        F.avg("result_count").alias("result_count_avg"),
    )
    rounded = F.bround("percentile", 0).cast("bigint").alias("elapsed_ms_p95")
    return totals.join(p95.select(*keys, rounded), list(keys), "left")


def indexing_throughput(runs: DataFrame) -> DataFrame:
    """Means per proposal and chunks per second, 0 where there is nothing to divide by."""
    ms, docs, chunks = F.col("elapsed_ms"), F.col("proposal_count"), F.col("chunk_count")
    return runs.select(
        "*",
        F.when(docs == 0, 0.0).otherwise(ms / docs).alias("per_proposal_ms_avg"),
        F.when(ms == 0, 0.0).otherwise(chunks / (ms / 1000.0)).alias("chunks_per_second"),
    )


def generation_measurements(drafts: DataFrame) -> DataFrame:
    """(section_type, elapsed_ms, top_k, citations, prompt, text) rows as measurements."""
    return drafts.select(
        "draft_path",
        "section_type",
        "elapsed_ms",
        F.size("citations").cast("bigint").alias("citation_count"),
        F.col("top_k").alias("top_k_examples"),
        F.length("prompt").cast("bigint").alias("prompt_length"),
        F.length("text").cast("bigint").alias("draft_length"),
    )
