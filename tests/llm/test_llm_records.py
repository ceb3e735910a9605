"""Chat formatting, byte-level BPE and archives."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
import tiktoken
import zstandard

from folioflow.llm import bpe, chat, shared, warc


def rendered(source: str, **values) -> str:
    return "".join(text for text, _ in chat.compile_template(source)(values))


def test_templates_are_parsed_folded_and_run():
    source = "a{{ 'b' + 'c' }}{% if 1 == 2 %}never{% elif x != 'q' and not y %}{{ x | trim }}{% else %}-{% endif %}"
    assert rendered(source, x=" z ", y="") == "abcz"
    assert rendered(source, x="q", y="") == "abc-"
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}never{% else %}d{% endif %}")) == (chat.Text("abcd"),)
    assert rendered("{% for m in ms %}[{{ m.a + (m.b or '!') }}]{% endfor %}", ms=[{"a": "1", "b": ""}]) == "[1!]"
    masks = list(chat.compile_template("u{% generation %}v{{ x }}{% endgeneration %}w")({"x": "y"}))
    assert masks == [("u", False), ("v", True), ("y", True), ("w", False)]


@pytest.mark.parametrize(
    "source",
    ["{{ }}", "{{ 'a }}", "{{ a b }}", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a | open }}", "{{ (a }}",
     "{{ a() }}", "{% import os %}"],
)
def test_unknown_templates_are_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_fields_are_keys_and_never_attributes():
    with pytest.raises(chat.TemplateError):
        rendered("{{ x.upper }}", x="text")
    with pytest.raises(KeyError):
        rendered("{{ x.__class__ }}", x={})


def test_escapes_come_back():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices("<|\\n\n>a", k=rng.randint(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        line = chat.escape_line(text)
        assert "<|" not in line and "\n" not in line and chat.unescape_line(line) == text


def test_conversations_come_back_from_their_formatted_text(spark):
    rows = [
        (1, 1, "assistant", chat.HOSTILE), (1, 0, "user", "<|im_start|>\\<\\|"), (1, 2, "user", None), (1, 2, None, "x"),
        (2, 0, "sys\ntem", ""), (2, 1, "assistant", "é" * 30000), (2, 1, "assistant", "é"), (None, None, "user", "z"), (3, 5, "tool", "t"),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, spans string, m int")
    formatted = {r["conv_id"]: r for r in chat.format_conversations(table).collect()}
    digests = {r["conv_id"]: r for r in chat.conversation_digests(table).collect()}
    assert set(formatted) == set(digests) == {1, 2, 3, None}
    for conv, row in digests.items():
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x) for x in r[1:]])
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        text = formatted[conv]["formatted"]
        assert row["n_turns"] == len(turns) and row["formatted_chars"] == len(text)
        assert row["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert "".join(chat.unescape(text[s["start"] : s["stop"]]) for s in formatted[conv]["loss_spans"]) == loss
    assert chat.conversation_digests(table.where("conv_id > 9")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    tokens = bpe.read_vocabulary()
    return bpe.Encoder(tokens, bpe.PerfectHash(tokens))


@pytest.fixture(scope="module")
def reference(encoder):
    ranks = {t: i for i, t in enumerate(encoder.tokens)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_perfect_hash_is_minimal_and_finds_every_key(encoder):
    found = encoder.table.entries(encoder.tokens)
    assert (found == np.arange(len(encoder.tokens))).all()
    assert sorted(encoder.table.entry.tolist()) == list(range(len(encoder.tokens)))
    small = bpe.PerfectHash([b"a"])
    assert small.entries([b"a", b"zz"]).tolist() == [0, 0]


def test_ids_equal_the_public_library(encoder, reference, monkeypatch):
    rng = random.Random(2)
    letters = [*"abcdefghij'sreABC0123²½éñ中文😀!?#_<|> \t\n\r\x0b\x1c\x85  　​", "the ", "ing ", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "a" * 30000 + "é" * 9000, " " * 5000 + "x", "<|endoftext|>"]
    for ids, text in zip(encoder.encode_all(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    monkeypatch.setattr(bpe, "PIECES", 20)
    fresh = bpe.Encoder(encoder.tokens, encoder.table)
    assert fresh.encode_all(texts[:500]) == [encoder.encode(t) for t in texts[:500]]
    assert len(fresh.known) <= 5000


def test_tokens_of_a_table(spark, reference):
    rows = [(1, "Some text, twice."), (1, "Some text, twice."), (2, None), (None, ""), (3, "naïve 中文 " * 4000)]
    table = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id bigint, text string, ids array<int>")
    digests = bpe.encode_documents(table).collect()
    expected = []
    for i, text in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, digests), key=str) == sorted(expected, key=str)
    data = bpe.decode_tokens(bpe.encode_tokens(table)).collect()
    assert sorted((bytes(r["data"]).decode() for r in data)) == sorted(t or "" for _, t in rows)
    assert bpe.encode_documents(table.where("doc_id > 9")).count() == 0


def test_archives_come_back(spark):
    long = "<p>" + "w " * 60 + "</p>"
    rows = [(7, "http://a/1", long), (3, "http://a/2", long), (3, "http://a/2", long), (9, None, long), (4, "u", "short"),
            (5, "u\r\nX: y", "short"), (6, "u", None), (None, "u", long), (8, "u", "é" * 200000), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    archives = warc.write_archives(table, shared.Scratch(spark), archive_bytes=2000)
    assert archives.count() > 1
    out = warc.read_archives(archives).collect()
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = 3 if html == long and page is not None and page > 3 else None
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first))
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)
    empty = warc.read_archives(warc.write_archives(table.where("page_id > 99"), shared.Scratch(spark)))
    assert empty.count() == 0


def archive(dictionary: bytes = b"", compressed: bool = False) -> bytes:
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    encoder = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    records = [warc.page_record(i, "http://a/", b"some payload " * 30 * i, "d", None) for i in range(3)]
    held = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return warc.archive_start(held) + b"".join(encoder.compress(r) for r in records)


def test_the_dictionary_may_be_absent_raw_or_compressed():
    dictionary = b"WARC/1.1 some payload http://a/ Content-Length" * 20
    for data in (archive(), archive(dictionary), archive(dictionary, compressed=True)):
        assert [len(r.payload) for r in warc.read_records(data)] == [0, 390, 780]
    assert list(warc.read_records(b"")) == []
    assert warc.train_dictionary([]) == warc.train_dictionary([b"x"]) == b""


@pytest.mark.parametrize(
    "damage",
    [lambda d: d[:-3], lambda d: d[:40] + bytes([d[40] ^ 255]) + d[41:], lambda d: b"no archive" + d,
     lambda d: struct.pack("<II", warc.DICTIONARY_MAGIC, 10**6) + d],
)
def test_damaged_archives_are_refused(damage):
    with pytest.raises(warc.ArchiveError):
        list(warc.read_records(damage(archive())))


@pytest.mark.parametrize(
    "record",
    [b"", b"HTTP/1.1 200 OK\r\n\r\n", warc.record_bytes({"WARC-Type": "response"}, b"x"),
     warc.page_record(1, "u", b"abc", "d", None)[:-1], warc.page_record(1, "u", b"abc", "d", None).replace(b"Length: 8", b"Length: 9")],
)
def test_records_with_wrong_headers_or_lengths_are_refused(record):
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(record)
