"""Rows that hang together over shared keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.lineage import materialise


def key_links(rows: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """(a, b): every row's ``node`` with the least node that shares a key with it.

    A key held by a third of all rows is one row of the aggregate and a star of links, never pairs.
    """
    links = None
    for key in keys:
        least = rows.groupBy(key).agg(F.min(node).alias("b"), F.count("*").alias("n")).filter("n > 1")
        some = rows.select(key, F.col(node).alias("a")).join(least, key).select("a", "b").filter("a <> b")
        links = some if links is None else links.union(some)
    return links.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); a component is named by its least node.

    Each round hangs a node's greater neighbours on its least one and then all on their least, so a
    chain shrinks by a factor a round, and a hub is a row of an aggregate. Rounds are checkpointed.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        wide = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = wide.groupBy("u").agg(F.min("v").alias("m"))
        tied = wide.join(near, "u")
        following = materialise(
            tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(tied.select("u", F.col("m").alias("v")))
            .distinct()
        )
        # stars are all that is left when a round changes nothing
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            break
        edges = following
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select("v", "v").distinct())
