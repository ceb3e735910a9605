"""Outbound-call decisions against an allowlist, and the records kept of them.

Works on a batch table of attempts and, unchanged, on a stream of them (stream-static join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.network import allowlist_host, is_loopback, iso_seconds, redact_path


def check_allowlist(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of (position, host, port, reason) rows; hosts are normalised."""
    checked = entries.withColumn("checked", allowlist_host(F.col("host")))
    port_ok = F.coalesce(F.col("port").between(1, 65535), F.lit(False))
    reason_ok = F.coalesce(F.length("reason") > 0, F.lit(False))
    problem = F.coalesce(
        F.col("checked.reason"),
        F.when(~port_ok, F.lit("bad_port")).when(~reason_ok, F.lit("empty_reason")),
    )
    valid = checked.filter(problem.isNull()).select(
        "position", F.col("checked.host").alias("host"), "port", "reason"
    )
    rejected = checked.filter(problem.isNotNull()).select(
        "position", "host", "port", "reason", problem.alias("problem")
    )
    return valid, rejected


def decide_egress(attempts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``decision_reason`` to (host, port, …) attempts.

    Loopback first, then the first allowlist entry for host and port, else denied. The list
    is reduced to one row per (host, port) before the join, so no attempt can fan out.
    """
    first = allowlist.groupBy(F.col("host").alias("list_host"), F.col("port").alias("list_port")).agg(
        F.min_by("reason", "position").alias("list_reason")
    )
    joined = attempts.join(
        first,
        (F.lower("host") == F.col("list_host")) & (F.col("port") == F.col("list_port")),
        "left",
    )
    loop = is_loopback(F.col("host"))
    listed = F.col("list_reason").isNotNull()
    return joined.select(
        *attempts.columns,
        F.when(loop | listed, "ALLOWED").otherwise("DENIED").alias("decision"),
        F.when(loop, F.lit("loopback"))
        .when(listed, F.concat(F.lit("allowlist match: "), F.col("list_reason")))
        .otherwise("not on allowlist")
        .alias("decision_reason"),
    )


def egress_records(decided: DataFrame) -> DataFrame:
    """What the log keeps: lower-cased host and scheme, first path segment, UTC seconds."""
    return decided.select(
        iso_seconds(F.col("ts")).alias("timestamp"),
        F.lower("host").alias("host"),
        F.col("port").cast("int").alias("port"),
        F.lower("scheme").alias("scheme"),
        redact_path(F.col("path")).alias("path"),
        "decision",
        F.col("decision_reason").alias("reason"),
        "source",
    )
