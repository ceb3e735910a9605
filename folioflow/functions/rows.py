"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column, *keep: str, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per element with its position, columns ``keep`` alongside.

    A plain ``explode`` of a computed array makes the optimizer add a non-empty filter below
    it, which computes the whole array a second time. The outer form does not; the row it
    gives for an empty array is dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
