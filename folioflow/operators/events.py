"""Usage events: builders from job tables, one typed union, canonical lines.

An event holds operational numbers and labels only. Each type has a closed set of fields
(``validation.EVENT_FIELDS``); the union keeps all of them as typed columns, and a line shows
exactly the fields of its own type, nulls included, sorted by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import iso_utc
from folioflow.operators.citations import status_mix
from folioflow.operators.validation import EVENT_COMMON, EVENT_FIELDS, EVENT_SCHEMA


def _typed(rows: DataFrame, of: str, keep: tuple[str, ...], at: Column | None, /, **fields: Column) -> DataFrame:
    """Rows as events of one kind: every column of the union, the fields of other kinds null."""
    undeclared = set(fields) - set(EVENT_FIELDS[of])
    if undeclared:
        raise ValueError(f"{of} has no {sorted(undeclared)}")
    given = {**fields, "event_type": F.lit(of), "timestamp": F.current_timestamp() if at is None else at}
    columns = []
    for declared in EVENT_SCHEMA.split(", "):
        name, spark_type = declared.split(" ", 1)
        columns.append(given.get(name, F.lit(None)).cast(spark_type).alias(name))
    return rows.select(*keep, *columns)


def draft_started(requests: DataFrame, *, model: Column, profile: Column, keep=(), at: Column | None = None) -> DataFrame:
    """Requests (section_type, programme, top_k, lessons_learned, topic_context_present) as they begin."""
    return _typed(
        requests, "draft_started", keep, at,
        section_type=F.col("section_type"), target_programme=F.col("programme"), top_k_examples=F.col("top_k"),
        lessons_learned=F.coalesce("lessons_learned", F.lit(False)), model=model, drafting_profile=profile,
        topic_context_present=F.col("topic_context_present"),
    )


def draft_completed(drafts: DataFrame, *, model: Column, profile: Column, keep=(), at: Column | None = None) -> DataFrame:
    """Drafts (section_type, elapsed_ms, citations, iteration) with the mix of their citations' statuses."""
    return _typed(
        drafts, "draft_completed", keep, at,
        section_type=F.col("section_type"), generation_time_ms=F.col("elapsed_ms"), citation_count=F.size("citations"),
        source_status_mix=status_mix(F.col("citations")), model=model, drafting_profile=profile,
        iteration_count=F.col("iteration"),
    )


def exported(exports: DataFrame, *, kind: Column, keep=(), at: Column | None = None) -> DataFrame:
    """Written artefacts (section_type, byte_count): what and how large, never the payload."""
    return _typed(
        exports, "export", keep, at, kind=kind, byte_count=F.col("byte_count"), section_type=F.col("section_type")
    )


def feedback(signals: DataFrame, *, keep=(), at: Column | None = None) -> DataFrame:
    """Signals (feedback_type, accepted, section_type, iteration_index) about drafts."""
    names = ("feedback_type", "accepted", "section_type", "iteration_index")
    return _typed(signals, "feedback", keep, at, **{n: F.col(n) for n in names})


def usage_events(*parts: DataFrame) -> DataFrame:
    """One typed table of events of any kind."""
    return reduce(DataFrame.unionByName, parts)


def with_defaults(events: DataFrame) -> DataFrame:
    """Absent fields that have a default take it: no statuses, one iteration, now."""
    completed = F.col("event_type") == "draft_completed"
    none = F.create_map().cast("map<string,int>")
    return events.withColumns(
        {
            "timestamp": F.coalesce("timestamp", F.current_timestamp()),
            "source_status_mix": F.when(completed, F.coalesce("source_status_mix", none)),
            "iteration_count": F.when(completed, F.coalesce("iteration_count", F.lit(1))),
        }
    )


def event_line(kind: str) -> Column:
    """The canonical line of an event of this kind."""
    fields = {name: F.col(name) for name in (*EVENT_COMMON, *EVENT_FIELDS[kind])}
    fields["timestamp"] = F.regexp_replace(iso_utc(F.col("timestamp")), r"\+00:00$", "Z")
    if "source_status_mix" in fields:
        fields["source_status_mix"] = F.map_from_entries(F.array_sort(F.map_entries("source_status_mix")))
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def event_lines(events: DataFrame, *keep: str) -> DataFrame:
    """(keep…, value): one line an event; only the fields of its own type, nulls as null."""
    line = F.coalesce(*[F.when(F.col("event_type") == kind, event_line(kind)) for kind in EVENT_FIELDS])
    return events.select(*keep, line.alias("value"))
