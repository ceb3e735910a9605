"""Append-only log streams: validated usage events and decided outbound calls.

Both are stateless per record, so no watermark is involved and memory does not grow with
the stream. Every sink has its own folder and checkpoint, which gives exactly-once files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.egress import decide_egress, egress_records
from folioflow.operators.events import event_lines, with_defaults
from folioflow.operators.validation import check_events
from folioflow.sources.event_log import sorted_columns

ATTEMPT = "ts timestamp, host string, port int, scheme string, path string, source string"


def _append(df: DataFrame, folder: str, checkpoint: str, form: str = "json") -> StreamingQuery:
    """Lines as a batch writes them: sorted keys, and a null field as null."""
    return (
        sorted_columns(df)
        .writeStream.format(form)
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", False)
        .trigger(availableNow=True)
        .start()
    )


def usage_event_stream(
    spark: SparkSession, inbox: str, log: str, rejects: str, checkpoints: str
) -> list[StreamingQuery]:
    """Raw JSON lines to the event log; lines that break the closed schema are diverted.

    The reject log keeps the reasons and a hash of the line, never the line itself, since it
    may hold content that must not be logged.
    """
    checked = check_events(spark.readStream.text(inbox))
    good = checked.filter(F.size("reasons") == 0).select("event.*")
    bad = checked.filter(F.size("reasons") > 0).select(
        F.sha2("value", 256).alias("line_hash"), "reasons"
    )
    return [
        _append(event_lines(with_defaults(good)), log, f"{checkpoints}/events", "text"),
        _append(bad, rejects, f"{checkpoints}/rejects"),
    ]


def egress_stream(
    spark: SparkSession, inbox: str, allowlist: DataFrame, log: str, checkpoint: str
) -> StreamingQuery:
    """Outbound-call attempts (JSON lines) to decided, redacted records."""
    attempts = spark.readStream.schema(ATTEMPT).json(inbox)
    return _append(egress_records(decide_egress(attempts, allowlist)), log, checkpoint)
