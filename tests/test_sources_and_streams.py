from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import egress, events, validation
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.events import with_defaults
from folioflow.operators.validation import check_events
from folioflow.sources import dimensions, documents, drafts, event_log, reports, sidecars
from folioflow.sources.chunk_table import ChunkTable
from folioflow.sources.synthetic import synthetic_corpus
from folioflow.streaming import ingest, logs


def _write(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")


def test_parsed_documents_round_trip(spark, tmp_path):
    section = {"heading": "H", "level": 1, "text": "t", "page_start": 1, "page_end": 2,
               "tables": [{"section_heading": "H", "rows": [["a"], ["b", "c"]], "page": 2}]}
    _write(tmp_path / "in" / "x" / "doc.parsed.json", {"source_path": "/p/doc.pdf", "title": "T", "sections": [section]})
    row = documents.read_parsed(spark, str(tmp_path / "in")).first()
    assert row["document_id"] == "doc"
    assert row["sections"][0]["tables"][0]["rows"] == [["a"], ["b", "c"]]


def test_sidecars_flat_and_nested(spark, tmp_path):
    base = {"programme": "cef", "call_id": "C", "year": 2020, "outcome": "funded"}
    _write(tmp_path / "m" / "a.json", {**base, "source_path": "rel/a.pdf"})
    _write(tmp_path / "m" / "b.json", {"proposal": {**base, "source_path": "/abs/b.pdf", "language": "fr"}})
    rows = {r["document_id"]: r for r in documents.read_proposals(spark, str(tmp_path / "m")).collect()}
    assert rows["a"]["source_path"] == f"{tmp_path}/m/rel/a.pdf"
    assert rows["a"]["language"] == "en"
    assert (rows["b"]["source_path"], rows["b"]["language"]) == ("/abs/b.pdf", "fr")
    _write(tmp_path / "m" / "c.json", "[1, 2]x")
    with pytest.raises(Exception):
        documents.read_proposals(spark, str(tmp_path / "m")).collect()


def test_yaml_sidecars_flat_nested_and_malformed(spark, tmp_path):
    pytest.importorskip("yaml")
    flat = "programme: cef\ncall_id: 'C: 1'  # quoted\nyear: 2020\noutcome: funded\nsource_path: rel/a.pdf\ningested_at: 2024-05-01T10:00:00+02:00\n"
    nested = "chunk_index: 3\nproposal:\n  programme: cef\n  call_id: D\n  year: 2021\n  outcome: rejected\n  source_path: /abs/b.pdf\n  language: fr\n"
    _write(tmp_path / "m" / "x" / "a.yaml", flat)
    _write(tmp_path / "m" / "b.YML", nested)
    _write(tmp_path / "m" / "c.txt", "no sidecar")
    rows = {r["document_id"]: r for r in sidecars.read_sidecars(spark, str(tmp_path / "m")).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["call_id"], rows["a"]["year"], rows["a"]["language"]) == ("C: 1", 2020, "en")
    assert rows["a"]["source_path"] == f"{tmp_path}/m/x/rel/a.pdf" and rows["a"]["ingested_at"].hour == 8
    assert (rows["b"]["source_path"], rows["b"]["language"]) == ("/abs/b.pdf", "fr")
    for name, text in {"d": "- a list", "e": 'call_id: "open', "f": flat + "text: secret\n", "g": flat.replace("2020", "[1]"), "h": "", "i": flat.replace("cef", "7")}.items():
        _write(tmp_path / "m" / f"{name}.yaml", text)
    kept = {r["sidecar"][-6:-5]: r["problem"] for r in sidecars.read_sidecars(spark, str(tmp_path / "m"), keep_problems=True).collect()}
    assert {k: v for k, v in kept.items() if v} == {
        "d": "not_a_mapping", "e": "malformed", "f": "extra:text", "g": "type:year", "h": "not_a_mapping", "i": "type:programme"
    }
    with pytest.raises(Exception, match="sidecar"):
        sidecars.read_sidecars(spark, str(tmp_path / "m")).collect()


def test_file_hashes_and_extension_filter(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.PDF").write_bytes(b"\x00\x01")
    (tmp_path / "d" / "b.txt").write_bytes(b"no")
    rows = documents.hash_files(spark, str(tmp_path)).collect()
    assert [(r["document_id"], r["content_hash"], r["bytes"]) for r in rows] == [
        ("a", hashlib.sha256(b"\x00\x01").hexdigest(), 2)
    ]


def test_drafts_scan_by_relative_path(spark, tmp_path):
    payload = {"section_type": "impact", "text": "x", "citations": [{"citation_id": 1, "source_status": None}]}
    _write(tmp_path / "runs" / "b" / "two.json", payload)
    _write(tmp_path / "runs" / "one.json", payload)
    got = drafts.read_drafts(spark, str(tmp_path / "runs"))
    assert sorted(r["draft_path"] for r in got.collect()) == ["b/two.json", "one.json"]
    _write(tmp_path / "runs" / "bad.json", '{"section_type": ')
    with pytest.raises(Exception):
        drafts.read_drafts(spark, str(tmp_path / "runs")).collect()
    only = drafts.read_drafts(spark, str(tmp_path / "runs"), pattern="o*.json")
    assert only.count() == 1


def test_event_log_append_and_export(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    events = spark.createDataFrame([("export", 2, None)], "event_type string, byte_count int, a string")
    event_log.append_log(events, log)
    event_log.append_log(events, log)
    lines = [r["value"] for r in spark.read.text(log).collect()]
    assert lines == ['{"a":null,"byte_count":2,"event_type":"export"}'] * 2
    _write(tmp_path / "log" / "part-extra.json", "\n  \n{}\n")
    assert event_log.export_lines(spark, log, out) == 3
    with pytest.raises(Exception):
        event_log.export_lines(spark, log, out)
    assert event_log.export_lines(spark, log, out, overwrite=True) == 3


def test_synthetic_corpus(spark):
    corpus = synthetic_corpus(spark, 3, 2)
    rows = corpus.orderBy("document_id").collect()
    assert [r["document_id"] for r in rows] == ["synthetic-000", "synthetic-001", "synthetic-002"]
    assert rows[1]["sections"][1]["heading"] == "1.2 Impact Pathway chapter 2"
    assert "impact pathway part 2 methodology" in rows[1]["sections"][1]["text"]
    assert chunk_documents(corpus).count() == 6
    with pytest.raises(ValueError):
        synthetic_corpus(spark, 0, 1)


def test_dimensions(spark):
    assert dimensions.default_guidance(spark).count() == 11
    assert dimensions.available_profiles() == ["digital_europe", "horizon_europe"]
    assert dimensions.profile_guidance(spark).count() == 22
    assert dimensions.terminology(spark).count() == 14
    assert dimensions.status_labels(spark).count() == 4


def test_report_is_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b", "y"), (0, "", "head"), (1, "a", "x")], "part int, key string, value string")
    reports.write_report(lines, str(tmp_path / "r"), "part", "key")
    parts = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == "head\nx\ny\n"
    pair = spark.createDataFrame([(2, "x")], "b int, a string")
    assert reports.to_json_lines(pair).first()["value"] == '{"a":"x","b":2}'


GOOD = {"event_type": "feedback", "timestamp": "2024-01-01T00:00:00Z", "feedback_type": "up", "accepted": True}


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, []),
        ({"comment": "text"}, ["extra:comment"]),
        ({"accepted": None}, ["missing:accepted"]),
        ({"accepted": "maybe"}, ["type:accepted"]),
        ({"iteration_index": -1}, ["range:iteration_index"]),
        ({"feedback_type": ""}, ["range:feedback_type"]),
        ({"event_type": "other"}, ["event_type"]),
        ({"timestamp": "never"}, ["type:timestamp"]),
    ],
)
def test_event_schema_is_closed(spark, change, reasons):
    line = json.dumps({**GOOD, **change})
    df = spark.createDataFrame([(line,)], "value string")
    assert validation.check_events(df).first()["reasons"] == reasons


def test_defaulted_event_fields_may_be_absent_but_not_null(spark):
    done = {"event_type": "draft_completed", "timestamp": "2024-01-01T00:00:00Z", "section_type": "impact",
            "generation_time_ms": 1, "citation_count": 0, "model": "m"}
    lines = [done, {**done, "source_status_mix": {"funded": 1}, "iteration_count": 1}]
    lines += [{**done, "source_status_mix": None}, {**done, "iteration_count": None}, {**done, "drafting_profile": None}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)], "i int, value string")
    reasons = [r["reasons"] for r in validation.check_events(df).orderBy("i").collect()]
    assert reasons == [[], [], ["type:source_status_mix"], ["type:iteration_count"], []]



@pytest.mark.parametrize("name", ["user_intent", "prompt", "text", "snippet", "passage", "body", "payload", "content"])
def test_content_fields_are_always_refused(spark, name):
    df = spark.createDataFrame([(json.dumps({**GOOD, name: {"nested": 1}}),)], "value string")
    assert validation.check_events(df).first()["reasons"] == [f"extra:{name}"]


def test_usage_event_stream_diverts_rejects(spark, tmp_path):
    _write(tmp_path / "in" / "1.jsonl", "\n".join([json.dumps(GOOD), json.dumps({**GOOD, "text": "secret"}), "not json"]))
    args = [str(tmp_path / n) for n in ("in", "log", "rejects", "cp")]

    def run():
        for q in logs.usage_event_stream(spark, *args):
            q.awaitTermination()

    run()
    run()  # nothing new: nothing is written twice
    kept = [json.loads(r["value"]) for r in spark.read.text(args[1]).collect()]
    assert [(k["event_type"], k["feedback_type"], k["accepted"]) for k in kept] == [("feedback", "up", True)]
    rejected = spark.read.text(args[2]).collect()
    assert len(rejected) == 2 and not any("secret" in r["value"] for r in rejected)
    _write(tmp_path / "in" / "2.jsonl", json.dumps(GOOD))
    run()
    assert spark.read.text(args[1]).count() == 2


def test_streamed_events_are_the_lines_a_batch_appends(spark, tmp_path):
    lines = [
        {"event_type": "draft_started", "timestamp": "2024-05-01T10:00:00Z", "section_type": "impact", "target_programme": None,
         "top_k_examples": 3, "lessons_learned": False, "model": "m", "drafting_profile": None, "topic_context_present": True},
        {"event_type": "draft_completed", "timestamp": "2024-05-01T10:00:01.250Z", "section_type": "impact", "generation_time_ms": 5,
         "citation_count": 2, "source_status_mix": {"funded": 1, "esr_note": 1}, "model": "m", "drafting_profile": None, "iteration_count": 2},
        {"event_type": "export", "timestamp": "2024-05-01T10:00:02Z", "kind": "json", "byte_count": 7, "section_type": None},
        {"event_type": "feedback", "timestamp": "2024-05-01T10:00:03Z", "feedback_type": "up", "accepted": True, "section_type": None,
         "iteration_index": None},
    ]
    short = {k: v for k, v in lines[1].items() if k not in ("source_status_mix", "iteration_count", "drafting_profile")}
    _write(tmp_path / "in" / "1.jsonl", "\n".join(map(json.dumps, [*lines, short])))
    args = [str(tmp_path / n) for n in ("in", "log", "rejects", "cp")]
    for q in logs.usage_event_stream(spark, *args):
        q.awaitTermination()
    checked = check_events(spark.read.text(args[0])).filter("size(reasons) = 0").select("event.*")
    event_log.append_events(with_defaults(checked), str(tmp_path / "batch"))
    streamed, appended = (sorted(r["value"] for r in spark.read.text(str(p)).collect()) for p in (args[1], tmp_path / "batch"))
    lines[1]["timestamp"] = "2024-05-01T10:00:01.250000Z"
    full = {**lines[1], "source_status_mix": {}, "iteration_count": 1}
    assert streamed == appended == sorted(json.dumps(x, sort_keys=True, separators=(",", ":")) for x in [*lines, full])


def test_builders_refuse_undeclared_fields(spark):
    with pytest.raises(ValueError):
        events._typed(spark.range(1), "export", (), None, text=F.lit("secret"))
    made = events.feedback(spark.createDataFrame([("up", True, None, None)], "feedback_type string, accepted boolean, section_type string, iteration_index int"))
    assert made.first()["timestamp"] is not None and made.first()["kind"] is None


def test_egress_stream(spark, tmp_path):
    attempt = {"ts": "2024-01-01T10:00:00Z", "host": "EC.Europa.eu", "port": 443, "scheme": "HTTPS", "path": "/api/x?k=1", "source": "s"}
    rows = [attempt, {**attempt, "host": "[::1]", "port": 1}, {**attempt, "port": 80}]
    _write(tmp_path / "in" / "1.json", "\n".join(map(json.dumps, rows)))
    entries = spark.createDataFrame(
        [(0, " EC.europa.eu", 443, "portal"), (1, "ec.europa.eu", 443, "second"), (2, "http://x", 1, "r"), (3, "h", 0, "r")],
        "position int, host string, port int, reason string",
    )
    valid, rejected = egress.check_allowlist(entries)
    assert sorted(r["problem"] for r in rejected.collect()) == ["bad_port", "has_scheme"]
    logs.egress_stream(spark, str(tmp_path / "in"), valid, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    got = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted((g["host"], g["port"], g["decision"], g["reason"]) for g in got) == [
        ("[::1]", 1, "ALLOWED", "loopback"),
        ("ec.europa.eu", 80, "DENIED", "not on allowlist"),
        ("ec.europa.eu", 443, "ALLOWED", "allowlist match: portal"),
    ]
    assert {(g["path"], g["timestamp"], g["scheme"]) for g in got} == {("/api", "2024-01-01T10:00:00Z", "https")}


def _incoming(position, doc, digest, title, text):
    return {
        "position": position, "document_id": doc, "content_hash": digest, "proposal_title": title,
        "call_id": "C", "programme": "cef", "year": 2020, "source_status": "funded",
        "sections": [{"heading": "Impact", "level": 1, "text": text, "page_start": 1, "page_end": 1, "tables": []}],
    }


def test_ingest_stream_keeps_the_table_current(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        ingest.ingest_stream(spark, inbox, table, checkpoint).awaitTermination()
        return sorted((r["document_id"], r["text"]) for r in table.read().collect())

    first = [
        _incoming(1, "a", "h1", "A", "text a"),
        _incoming(2, "copy", "h1", "Z", "text a"),
        _incoming(3, "b", "h2", "B", "text b"),
    ]
    _write(tmp_path / "in" / "1.json", "\n".join(map(json.dumps, first)))
    assert run() == [("a", "text a"), ("b", "text b")]
    second = [
        _incoming(4, "a", "h3", "A", "text a revised"),
        _incoming(5, "soft", "h4", "B", "other text"),
        _incoming(6, "c", "h5", "C", "text c"),
    ]
    _write(tmp_path / "in" / "2.json", "\n".join(map(json.dumps, second)))
    assert run() == [("a", "text a revised"), ("b", "text b"), ("c", "text c")]
    assert run() == [("a", "text a revised"), ("b", "text b"), ("c", "text c")]
    row = table.read().filter(F.col("document_id") == "c").first()
    assert len(row["embedding"]) == 384 and row["section_type"] == "impact"


def test_ingest_batch_with_repeated_id_keeps_the_last(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    rows = [_incoming(1, "a", "h1", "A", "old"), _incoming(2, "a", "h2", "A", "new")]
    _write(tmp_path / "in" / "1.json", "\n".join(map(json.dumps, rows)))
    batch = spark.read.schema(ingest.INCOMING).json(str(tmp_path / "in"))
    outcome = ingest.ingest_batch(table, batch, ("files", 0))
    assert [r["text"] for r in table.read().collect()] == ["new"]
    assert sorted(r["outcome"] for r in outcome.collect()) == ["added", "reindexed"]


def test_forced_stream_replaces_in_order(spark, tmp_path):
    """A forced document counts as admitted at once: its keys block and what it replaced is free again."""
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        ingest.ingest_stream(spark, inbox, table, checkpoint, force=True).awaitTermination()
        return sorted((r["document_id"], r["text"]) for r in table.read().collect())

    first = [_incoming(1, "a", "h1", "A", "one"), _incoming(2, "b", "h2", "A", "two"), _incoming(3, "c", "h2", "C", "copy of b"),
             _incoming(4, "d", "h1", "D", "bytes of a, which is gone")]
    _write(tmp_path / "in" / "1.json", "\n".join(map(json.dumps, first)))
    assert run() == [("b", "two"), ("d", "bytes of a, which is gone")]
    second = [_incoming(5, "e", "h5", "A", "three"), _incoming(6, "b", "h2", "A", "two again")]
    _write(tmp_path / "in" / "2.json", "\n".join(map(json.dumps, second)))
    # e replaces b; then b's bytes are free, but its title is e's, so b replaces e
    assert run() == [("b", "two again"), ("d", "bytes of a, which is gone")]
    assert run() == [("b", "two again"), ("d", "bytes of a, which is gone")]


def test_no_stream_batch_is_lost_to_other_writes_or_a_new_checkpoint(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "main")
    inbox = tmp_path / "in"

    def run(checkpoint="cp"):
        ingest.ingest_stream(spark, str(inbox), table, str(tmp_path / checkpoint)).awaitTermination()
        return sorted(r["document_id"] for r in table.read().select("document_id").distinct().collect())

    _write(inbox / "1.json", json.dumps(_incoming(1, "a", "h1", "A", "text a")))
    assert run() == ["a"]
    table.compact()
    _write(inbox / "2.json", json.dumps(_incoming(2, "b", "h2", "B", "text b")))
    assert run() == ["a", "b"]
    table.upsert(table.read().withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))).withColumn("document_id", F.lit("u")))
    _write(inbox / "3.json", json.dumps(_incoming(3, "c", "h3", "C", "text c")))
    assert run() == ["a", "b", "c", "u"]
    table.drop()
    _write(inbox / "4.json", json.dumps(_incoming(4, "d", "h4", "D", "text d")))
    assert run() == ["d"]
    assert run("another") == ["a", "b", "c", "d"]


def test_export_leaves_out_lines_of_any_white_space(spark, tmp_path):
    _write(tmp_path / "log" / "a.json", '{"a": 1}\n\t\t\n   \n{"b": 2}\n')
    assert event_log.export_lines(spark, str(tmp_path / "log"), str(tmp_path / "out")) == 2
    event_log.append_log(spark.createDataFrame([(None, 1)], "b string, a int"), str(tmp_path / "new"))
    assert spark.read.text(str(tmp_path / "new")).first()["value"] == '{"a":1,"b":null}'
