"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Scratch


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("u").alias("node"), one.alias("hangs"), none.alias("holds")).union(
        edges.select("v", none, one)
    )
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.where("hangs > 1 OR (hangs > 0 AND holds > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: bigint); component is its smallest node.

    Alternating large-star and small-star steps: each joins every node with the least of its
    neighbours, so a hub is pre-aggregated and then split by the join, never gathered. The number
    of rounds is logarithmic; each is written to the shared folder. Self-links, repeated links and
    null ends are ignored; no edges give an empty table.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = scratch.save(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    turn = 0
    while not _settled(current):
        turn += 1
        both = current.union(current.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select(F.col("u"), F.col("m").alias("v")))
            .distinct()
        )
        current = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(current.select(F.col("v"), F.col("v")).distinct())
