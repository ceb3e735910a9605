"""Phrase counts of the index against plain counting, and scores, cuts and ranks against fractions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import collocations
from folioflow.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def pieces(text: str | None):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
        yield re.findall(r"[^\x20\x09]+", piece)


def counted(rows, max_words):
    out = Counter()
    for text, lang in rows:
        for words in pieces(text):
            out[lang or "und", ""] += len(words)
            for size in range(1, max_words + 1):
                for at in range(len(words) - size + 1):
                    out[lang or "und", " ".join(words[at : at + size])] += 1
    return Counter({k: v for k, v in out.items() if v})


def expected(rows, max_words, least, inside):
    f = {k: v for k, v in counted(rows, max_words).items() if v >= least or not k[1]}
    held = defaultdict(int)
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = lang, " ".join(words[at : at + size])
                held[key] = max(held[key], a)
    out = {}
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        if len(words) < 2 or 100 * held[lang, phrase] >= inside * a > 0 and held[lang, phrase]:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang, phrase] = (a, l, r, f[lang, ""], score)
    return out


def corpus(seed, texts=60):
    rng = random.Random(seed)
    words = ["a", "B", "the", "Of", "é", "x-y", "日本", "\x00z", "ab"]
    rows = []
    for _ in range(texts):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "fr"), (" .\n", "fr"), rows[0], rows[0], ("long " * 3000 + ". end", "en")]


@pytest.mark.parametrize("shard, depth", [(1 << 20, 3), (50, 3), (200, 5)])
def test_counts_equal_plain_counting(spark, shard, depth):
    rows = corpus(shard)
    table = spark.createDataFrame([(i, t, g, "clash", 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    found = collocations.phrase_counts(table, depth, 1, shard).collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in found if r["f"]} == counted(rows, depth)
    assert all(r["words"] == len(r["phrase"].split(" ")) * (r["phrase"] != "") for r in found)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_scores_and_containment(spark, depth):
    rows = corpus(9)
    table = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], SCHEMA)
    found = collocations.collocations(table, Scratch(spark), depth, 4, 50).collect()
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found} == expected(rows, depth, 4, 50)
    assert collocations.collocations(table.where("doc_id < 0"), Scratch(spark)).count() == 0


def test_ranks_break_ties_by_count_and_bytes(spark):
    rows = [("en", p, a, 1, 1, 9, s) for p, a, s in [("b b", 5, 7), ("a z", 5, 7), ("é a", 5, 7), ("c c", 6, 7), ("d d", 1, 8), ("e e", 9, 1)]]
    table = spark.createDataFrame(rows, "lang string, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    ranked = {r["rank"]: r["phrase"] for r in collocations.top_collocations(table, 5).collect()}
    assert ranked == {1: "d d", 2: "c c", 3: "a z", 4: "b b", 5: "é a"}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_007
    row = spark.createDataFrame([(big, big, big + 2)], "a bigint, l bigint, r bigint").select(
        collocations._score(*map(collocations.F.col, "alr")).alias("s")
    ).first()
    assert row["s"] == 1_000_000 * big * big // (big * (big + 2))


@pytest.mark.parametrize("depth", [1, 2, 3, 7])
def test_suffixes_are_sorted_to_their_depth(depth):
    codes = np.array([random.Random(depth).randrange(5) for _ in range(300)] + [0], np.int64)
    order = collocations.suffix_order(codes, depth)
    padded = codes.tolist() + [0] * depth
    keys = [padded[i : i + depth] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(codes)))
