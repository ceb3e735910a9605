"""Edit fingerprints against a step-by-step walk, neighbours against a plain sort, and the search."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from folioflow.llm import fingerprints as fp
from folioflow.llm.shared import Scratch, mix

SCHEMA = "doc_id bigint, text string"


def stepwise(text: str) -> bytes:
    """The same fingerprint, one time step and one sample after the other."""
    out = []
    for seed in range(fp.WALKS):
        bits = fp._numbers(2 * seed, fp.CLASSES * fp.PERIOD)
        draws = fp._numbers(4 * seed + 1, fp.SAMPLES * 256)
        keys = fp._numbers(4 * seed + 3, fp.SAMPLES * fp.GRAM)
        written, time, place = [], 0, 0
        while place < len(text):
            written.append(ord(text[place]))
            kind = (ord(text[place]) * 2654435761 % (1 << 32) >> 11) % fp.CLASSES
            place += int(bits[kind * fp.PERIOD + time % fp.PERIOD]) >> 40 & 1
            time += 1
        for sample in range(fp.SAMPLES):
            at, draw = 0, 0
            while True:
                later = int((at + 1) / ((int(draws[sample * 256 + draw]) >> 11) + 1) * 2.0**53)
                if later >= len(written):
                    break
                at, draw = later, draw + 1
            gram = [(written[at + g] if at + g < len(written) else 0) + 1 for g in range(fp.GRAM)]
            total = sum(c * (int(keys[sample * fp.GRAM + g]) | 1) for g, c in enumerate(gram)) + at
            out.append(int(mix(np.array([total % (1 << 64)], np.uint64))[0]) >> 24 & 255)
    return bytes(out)


def prose(rng, words):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(words))


def test_table_of_states_equals_single_steps():
    rng = random.Random(5)
    for text in ["", "a", "ab", "é😀\x00", "x" * 3000, prose(rng, 40), prose(rng, 900)]:
        assert fp.fingerprint(text) == stepwise(text)
    assert fp.fingerprint(None) == fp.fingerprint("")


def test_likeness_follows_the_edits():
    rng = random.Random(6)
    one, none, third = [], [], []
    for _ in range(40):
        text, other = prose(rng, 300), prose(rng, 300)
        at = rng.randrange(len(text))
        one.append(fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:at] + "q" + text[at:])))
        none.append(fp.likeness(fp.fingerprint(text), fp.fingerprint(other)))
        walked = fp.Walked(text)
        edited, made = walked.edited(other)
        assert made == fp.fingerprint(edited)
        third.append(fp.likeness(walked.fingerprint, made))
    assert np.mean(one) > 0.8 and max(none) < 0.1 and 0.6 < np.mean(third) < 0.75 and min(third) > 0.5


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: r[1])
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        prints = [stepwise(t) for t in (text, edited, following)]
        near = [sum(a == b for a, b in zip(prints[0], p, strict=True)) / len(p) for p in prints[1:]]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[0].hex(), prints[1].hex(), *near))
    return out


def test_every_row_meets_the_next_one(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 30))) for i in rng.sample(range(-500, 500), 90)]
    rows += [(rows[3][0], "same id"), (rows[3][0], rows[3][1]), (None, "no id"), (None, None), (900, None), (901, ""), (902, "ü" * 7), rows[5]]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", bucket string").repartition(5)
    found = [tuple(r)[:7] for r in fp.edited_fingerprints(table).collect()]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(found, key=key) == sorted(expected(rows), key=key)


def test_few_rows_and_very_long_texts(spark):
    for rows in ([], [(4, "abcdef")], [(None, "b"), (None, "a" * 9)], [(1, "a"), (2, "long text " * 30_000)]):
        found = fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(r["edited_sha256"] for r in found) == sorted(r[2] for r in expected(rows))


def test_search_finds_edited_copies(spark):
    rng = random.Random(8)
    texts = [prose(rng, 200) for _ in range(120)]
    copies = [t[:700] + "q" + t[703:1000] + "xy" + t[1000:] for t in texts[:20]]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(copies)] + [(2000, texts[0]), (None, texts[0])]
    table = spark.createDataFrame(rows, SCHEMA)
    queries = table.where("doc_id < 20")
    found = {(r["query_id"], r["class_id"]): r["likeness"] for r in fp.near_documents(queries, table, Scratch(spark)).collect()}
    classes = {}
    for i, text in rows[:-1]:
        classes.setdefault(fp.fingerprint(text), i)
    near = {(classes[q], d): fp.likeness(q, f) for f, d in classes.items() for q in map(fp.fingerprint, texts[:20])}
    assert found == {k: v for k, v in near.items() if v >= fp.LIKENESS}
    copied = [classes[fp.fingerprint(c)] for c in copies]
    assert sum((i, c) in found for i, c in enumerate(copied)) >= 15 and found[5, 5] == 1
    assert any(0.5 < v < 1 for v in found.values())
