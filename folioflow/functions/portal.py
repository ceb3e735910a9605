"""Column functions over funding-portal links and stored search payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import let, strip

SEARCH_PAYLOAD = (
    "struct<results: array<struct<metadata: struct<identifier: array<string>, "
    "callIdentifier: string, title: string, callTitle: string>>>>"
)


def portal_topic(url: Column) -> Column:
    """``struct(topic_id, reason)``: the topic id, or why the link has none."""

    def fields(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
        authority = F.regexp_extract(u, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
        bare = F.regexp_replace(authority, r"(?s)\A.*@", "")
        host = F.lower(F.regexp_extract(bare, r"\A([^:]*)", 1))
        path = F.regexp_extract(u, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)
        segment = F.regexp_extract(path, r"/topic-details/([^/;]*)", 1)
        topic = F.regexp_replace(segment, r"\.json\z", "")
        reason = (
            F.when(~scheme.isin("http", "https"), "bad_scheme")
            .when(host == "", "missing_host")
            .when(~host.isin(*vocab.PORTAL_HOSTS), "foreign_host")
            .when(~path.contains("/topic-details/"), "no_topic_segment")
            .when(~topic.rlike(rf"\A(?:{vocab.PORTAL_TOPIC_SHAPE})\z"), "bad_topic_shape")
        )
        return F.struct(F.when(reason.isNull(), topic).alias("topic_id"), reason.alias("reason"))

    return let(strip(url), fields)


def first_value(raw: Column) -> Column:
    """Search payloads wrap scalars in one-element lists; give the first or an empty text."""
    head = F.get(F.from_json(raw, "array<string>"), F.lit(0))
    return F.coalesce(F.when(raw.startswith("["), head).otherwise(raw), F.lit(""))


def call_context(payload: Column, topic_id: Column) -> Column:
    """Pick the result whose identifier equals ``topic_id``; reason instead of an error."""
    parsed = F.from_json(payload, SEARCH_PAYLOAD)

    def fields(hit: Column) -> Column:
        call = first_value(hit.metadata.callIdentifier)
        title = first_value(hit.metadata.title)
        found = hit.isNotNull()
        complete = (call != "") & (title != "")
        return F.struct(
            F.when(found & complete, call).alias("call_id"),
            F.when(found & complete, title).alias("topic_title"),
            F.when(found & complete, first_value(hit.metadata.callTitle)).alias("call_title"),
            F.when(~found, "topic_not_found")
            .when(~complete, "payload_incomplete")
            .alias("reason"),
        )

    hits = F.filter(
        parsed.results, lambda r: F.coalesce(
            F.array_contains(r.metadata.identifier, topic_id), F.lit(False)
        )
    )
    return let(F.get(hits, F.lit(0)), fields)

