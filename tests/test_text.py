from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow.functions import ids, network, portal, text, topics

X = F.col("x")


@pytest.mark.parametrize(
    "heading, expected",
    [
        ("Impact pathway and impact", "impact_pathway"),
        ("2. IMPACT", "impact"),
        ("Workplan", "work_plan"),
        ("Partners", "consortium"),
        ("Resources to be committed", "budget"),
        ("Exploitation", "dissemination"),
        ("Annex", "other"),
        ("", "other"),
    ],
)
def test_section_type(one, heading, expected):
    assert one(text.infer_section_type(X), "x string", heading) == expected


def test_strip_covers_unicode_white_space(one):
    raw = " \x1c \t body　 "
    assert one(text.strip(X), "x string", raw) == raw.strip() == "body"


def test_collapse_equals_python_split(one):
    raw = " a b\x1f\n\n c  "
    assert one(text.collapse_whitespace(X), "x string", raw) == " ".join(raw.split())


@pytest.mark.parametrize("size", [299, 300, 301])
def test_snippet_length(one, size):
    out = one(text.snippet(X), "x string", "a" * size)
    assert out == ("a" * size if size <= 300 else "a" * 299 + "…")


def test_normalise(one):
    assert one(text.normalise_text(X), "x string", "﻿a\r\n\r\r\n\n\nb") == "a\n\nb"


def test_markers_keep_any_length(one):
    raw = "[1] [007] [12345678901234567890123] [x] [ 2 ]"
    assert one(text.citation_markers(X), "x string", raw) == ["1", "7", "12345678901234567890123"]
    assert one(text.citation_markers(X, 2), "x string", "[1] [100] [00]") == ["1", "0"]


@pytest.mark.parametrize(
    "path, expected",
    [
        ("/a/b/my.proposal.pdf", "my.proposal"),
        ("plain", "plain"),
        (".hidden", ".hidden"),
        ("/", "/"),
        ("dir.x/name", "name"),
        ("a/b.pdf/", "b"),
    ],
)
def test_document_id(one, path, expected):
    assert one(ids.document_id(X), "x string", path) == expected


def test_chunk_id_is_not_truncated(one):
    import hashlib

    digest = hashlib.sha256(b"__no_section__").hexdigest()[:12]
    out = one(ids.chunk_id(F.lit("d"), X, F.lit(1234567)), "x string", "")
    assert out == f"d::{digest}::1234567"


@pytest.mark.parametrize(
    "raw, programme, call, topic",
    [
        ("proposal_HE-CL3-2024-PartB_952672", "horizon_europe", "HE-CL3-2024", "952672"),
        ("XH2020-foo", None, None, None),
        ("HORIZON-CL4-2024-FINAL-draft", "horizon_europe", "HORIZON-CL4-2024", None),
        ("h2020_9526720", "horizon_2020", None, "9526720"),
        ("HORIZON_CL4-2024", None, None, None),
        ("HORIZON_2020", "horizon_2020", None, None),
        ("12345678 H2020-SU-ICT", "horizon_2020", "H2020-SU-ICT", None),
        ("H2020é-a", "horizon_2020", "H2020é-a", None),
    ],
)
def test_call_fields(one, raw, programme, call, topic):
    build = F.struct(
        topics.programme_of(X).alias("p"), topics.call_id_of(X).alias("c"), topics.topic_id_of(X).alias("t")
    )
    assert tuple(one(build, "x string", raw)) == (programme, call, topic)


EXCERPT = """Programme: Horizon Europe
Call: HORIZON-CL3-2024-CS-01
Topic: 952672
Topic title: Resilient systems
Destination: Secure society

Expected Outcomes:
- first outcome
  continued here
* second outcome
3. third outcome

Scope:
One   paragraph
of text.

Another one.
Methodology guidance:
Use methods.
Type of action: RIA
"""


def test_topic_context(one):
    t = one(topics.topic_context(X), "x string", EXCERPT)
    assert t["programme"] == "horizon_europe"
    assert t["call_id"] == "HORIZON-CL3-2024-CS-01"
    assert t["topic_id"] == "952672"
    assert t["topic_title"] == "Resilient systems"
    assert t["destination"] == "Secure society"
    assert t["expected_outcomes"] == [
        "first outcome continued here",
        "second outcome",
        "third outcome",
    ]
    assert t["scope"] == "One paragraph of text.\n\nAnother one."
    assert t["section_guidance"] == {"methodology": "Use methods."}
    assert t["source"] == "pasted_text"


def test_topic_numeric_title_is_dropped_and_paragraph_outcomes(one):
    raw = "Topic: 883588\nExpected outcomes\nA b.\n\nC d."
    t = one(topics.topic_context(X), "x string", raw)
    assert t["topic_title"] is None
    assert t["expected_outcomes"] == ["A b.", "C d."]
    empty = one(topics.topic_is_empty(topics.topic_context(X)), "x string", "nothing here")
    assert empty is True


def test_synthesised_metadata_precedence(one):
    out = one(
        topics.synthesised_metadata(X, {"year": F.lit(2030), "programme": F.lit("cef")}),
        "x string",
        "/in/H2020-SU-ICT-2019_883588.pdf",
    )
    assert out["programme"] == "cef"
    assert out["year"] == 2030
    assert out["call_id"] == "H2020-SU-ICT-2019"
    assert out["proposal_title"] == "H2020-SU-ICT-2019_883588"
    assert out["outcome"] == "funded"


@pytest.mark.parametrize(
    "url, topic, reason",
    [
        ("https://ec.europa.eu/a/topic-details/HORIZON-CL3-2026-02", "HORIZON-CL3-2026-02", None),
        ("https://ec.europa.eu/topic-details/sc1-phe-2020.json?x=/y", "sc1-phe-2020", None),
        ("ftp://ec.europa.eu/topic-details/HORIZON-CL3-2026-02", None, "bad_scheme"),
        ("not a url", None, "bad_scheme"),
        ("http:///topic-details/HORIZON-CL3-2026-02", None, "missing_host"),
        ("https://ec.europa.eu.evil.org/topic-details/HORIZON-CL3-2026", None, "foreign_host"),
        ("https://ec.europa.eu/x?topic-details/HORIZON-CL3-2026", None, "no_topic_segment"),
        ("https://ec.europa.eu/topic-details/abc", None, "bad_topic_shape"),
    ],
)
def test_portal_topic(one, url, topic, reason):
    assert tuple(one(portal.portal_topic(X), "x string", url)) == (topic, reason)


@pytest.mark.parametrize(
    "host, expected",
    [
        ("localhost", True),
        (" LocalHost", True),
        ("127.0.0.1", True),
        ("127.255.255.254", True),
        ("127.0.0.256", False),
        ("127.1", False),
        ("128.0.0.1", False),
        ("::1", True),
        ("[::1]", True),
        ("[::1", False),
        ("0:0:0:0:0:0:0:1", True),
        ("::0001", True),
        ("::2", False),
        ("::ffff:127.0.0.1", True),
        ("::ffff:7f00:1", True),
        ("::ffff:10.0.0.1", False),
        ("example.com", False),
        ("localhost.example.com", False),
        ("", False),
    ],
)
def test_loopback(one, host, expected):
    assert one(network.is_loopback(X), "x string", host) is expected


@pytest.mark.parametrize(
    "path, expected",
    [("", "/"), ("/", "/"), ("/api/embed/v1", "/api"), ("api?q=1", "/api"), ("//a/b", "/a"), ("?s", "/"), ("/#f", "/")],
)
def test_redacted_path(one, path, expected):
    assert one(network.redact_path(X), "x string", path) == expected


def test_utc_seconds_in_another_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        ts = F.timestamp_seconds(F.lit(0))
        assert spark.range(1).select(network.iso_seconds(ts)).first()[0] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
