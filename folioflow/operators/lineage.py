"""Cutting lineage, and broadcasting what has been counted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names, so lost executors cost nothing.

    The folder is that of spark.checkpoint.dir or setCheckpointDir(). Without one this raises: a
    folder that is guessed here would be one that no other node sees.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: computed once, read by column."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    path = f"{folder.rstrip('/')}/{context.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side whose values take at most ``limit`` bytes; leave a larger one alone.

    Without the hint a join with a computed side of unknown size shuffles the big side too. Texts and
    binaries are measured, other values and every row count 8 bytes. The caller passes a stored or
    materialised table, so measuring it is cheap.
    """
    size = F.lit(8)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    total = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df
