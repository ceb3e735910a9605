"""Structure repair against an exhaustive recursion, odd rows, and the damage rule."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import pytest

from folioflow.llm.repair import Row, conversation_repairs, damaged, op12_conversation_repair, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def least(rows):
    """(cost, audit) over all edit sequences with at most two inserts in a row."""

    @functools.lru_cache(None)
    def rest(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        steps = []
        if inserted < 2:
            steps.append((3, "I", i, AFTER[last][-1], inserted + 1))
        if i < len(rows):
            initial, must_go, truncated = rows[i].initial, rows[i].must_go, 3 * rows[i].truncated
            steps.append((4, "D", i + 1, last, 0))
            if not must_go:
                steps.append((3 + truncated, "R", i + 1, AFTER[last][-1], 0))
                if initial in AFTER[last]:  # an empty initial is in every string
                    steps.append((truncated, "K", i + 1, initial or last, 0))
        for cost, letter, *state in steps:
            then = rest(*state)
            if then:
                found.append((cost + then[0], letter + then[1]))
        return min(found, default=None)

    return rest(0, "", 0)


@pytest.mark.parametrize("seed", range(6))
def test_repairs_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(700):
        roles = rng.choice(["ua", "sua", "suaxu", "sssu", ["", "u", "a", "s"]])
        rows = [
            Row(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(0, 11))
        ]
        cost, path = repair(rows)
        assert (cost, "".join(x for x, _ in path)) == least(tuple(rows))


def test_a_very_long_conversation():
    rng = random.Random(1)
    rows = [Row("ua"[i % 2], rng.random() < 0.05, rng.random() < 0.1) for i in range(4000)]
    cost, path = repair(rows)
    assert sum(x != "I" for x, _ in path) == len(rows)
    lone = [Row("u")] * 3000
    cost, path = repair(lone)
    assert cost == 4500 and {x for x, _ in path} == {"K", "R"}


def plain(rows):
    """Expected counts by conversation after damage, for rows with distinct turns."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if k == 0:
            continue
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def test_damage_and_counts(spark):
    rng = random.Random(3)
    words = ["a.", "b", "c!", " ", "", None, "d?\n", "e."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(words)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, None, "user", "x."), (5, None, "assistant", None)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", place string").repartition(5)
    found = {r["conv_id"]: r for r in conversation_repairs(damaged(table)).collect()}
    expected = plain(rows)
    assert set(found) == set(expected) and len(found) == 61
    for conv, turns in expected.items():
        row, seen, counts, rows_, pairs = found[conv], set(), [0, 0, 0], [], 0
        for place, (_, role, text) in enumerate(turns):
            bare = text.strip(" \t\n\r\x0b\x0c")
            kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                counts[kind] += 1
            rows_.append(Row(role[:1], kind in (0, 1), kind == 2))
            if place:
                pairs += turns[place - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = {t for t, _, _ in turns if t is not None}
        assert row["gaps"] == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)
        assert [row["blank"], row["duplicate"], row["truncated"], row["illegal"]] == [*counts, pairs]
        assert (row["cost"], row["audit"]) == least(tuple(rows_))
        text, rest, last = [], iter(turns), ""
        for letter in row["audit"]:
            step = AFTER[last][-1]
            if letter == "I":
                role, body, last = {"u": "user", "a": "assistant"}[step], "", step
            else:
                _, role, body = next(rest)
                if letter == "D":
                    continue
                if letter == "R":
                    role = {"u": "user", "a": "assistant"}[step]
                last = role[:1] or last
            text.append(f"{role}:{body}")
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(text).encode()).hexdigest()


def test_empty_tables_and_emptied_conversations(spark):
    assert conversation_repairs(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = conversation_repairs(damaged(spark.createDataFrame([(1, gone, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_query_returns_every_conversation(spark):
    out = op12_conversation_repair(spark, "/root/testdata/sf0.001")
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert out.count() == given.select("conv_id").distinct().count()
