from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import chunking, structure
from folioflow.operators.structure import ITEM, RAW_TABLE


def _sections(spark, items):
    df = spark.createDataFrame([(items,)], f"items array<{ITEM}>")
    return [tuple(s) for s in df.select(structure.sections_of(F.col("items")).alias("s")).first()["s"]]


def test_sections_close_on_blank_header_and_drop_orphans(spark):
    items = [
        ("text", 1, "cover", None, [1]),
        ("section_header", 1, " A ", 9, [0, 2]),
        ("text", 1, "one", None, [2]),
        ("text", 2, "nested", None, [7]),
        ("text", 1, "  ", None, [3]),
        ("section_header", 1, "  ", 1, [4]),
        ("text", 1, "lost", None, [4]),
        ("section_header", 1, "B", None, None),
        ("text", 1, "two", None, [5]),
    ]
    assert _sections(spark, items) == [("A", 6, "one", 2, 3), ("B", 1, "two", 5, 5)]


def test_title_is_first_named_item(one):
    items = [("section_header", 1, " ", 1, []), ("section_header", 1, "H", 1, []), ("title", 1, "T", None, [])]
    build = structure.document_title(F.col("i"), F.col("n"))
    assert one(build, f"i array<{ITEM}>, n string", items, "name") == "H"
    assert one(build, f"i array<{ITEM}>, n string", [], " name ") == "name"


def test_grid_last_write_wins_and_out_of_range_dropped(one):
    table = (2, 2, [1], [(0, 0, "a"), (0, 0, " b "), (1, 1, "c"), (2, 0, "x"), (0, -1, "y")])
    rows = one(structure.table_grid(F.col("t")), f"t {RAW_TABLE}", table)
    assert rows == [["b", ""], ["", "c"]]


SPAN = "array<struct<page_start: int, page_end: int>>"


@pytest.mark.parametrize(
    "page, expected", [(2, 0), (3, 1), (7, 2), (1, 2), (None, 2), (9, 2)]
)
def test_table_page_falls_back_to_listed_sections(one, page, expected):
    spans = [(2, 2), (3, 5), (4, 4)]
    build = structure.section_for_page(F.col("s"), F.col("p"))
    assert one(build, f"s {SPAN}, p int", spans, page) == expected


def _spans(text, target, overlap, minimum, tolerance):
    """The splitting rule, stated plainly."""
    n, out, cursor = len(text), [], 0
    while cursor < n:
        if n - cursor <= target:
            out.append((cursor, n))
            break
        at = cursor + target
        low, high = max(0, at - tolerance), min(n, at + tolerance)
        end = at
        for marker in ("\n\n", ". ", "? ", "! "):
            hit = text.rfind(marker, low, high)
            if hit >= 0:
                end = hit + len(marker)
                break
        if end <= cursor:
            end = min(at, n)
        out.append((cursor, end))
        cursor = max(end - overlap, cursor + 1)
    if len(out) > 1 and out[-1][1] - out[-1][0] < minimum:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        chunking.ChunkSizes(),
        chunking.ChunkSizes(50, 10, 20, 15),
        chunking.ChunkSizes(30, 29, 0, 40),
        chunking.ChunkSizes(2000, 0, 300, 900),
    ],
)
def test_spans_equal_plain_rule(spark, sizes):
    rng = random.Random(7)
    pieces = ["word", ". ", "? ", "! ", "\n\n", "é", "𝒳", " ", "longerword"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 2500))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", "t", chunking.text_spans(F.col("t"), sizes).alias("s")).collect()
    for row in got:
        want = _spans(row["t"], sizes.target, sizes.overlap, sizes.minimum, sizes.tolerance)
        assert [(s["char_start"], s["char_end"]) for s in row["s"]] == want
        assert [s["text"] for s in row["s"]] == [row["t"][a:b] for a, b in want]


@pytest.mark.parametrize("bad", [(0, 0, 0), (10, 10, 0), (10, -1, 0), (10, 2, -1)])
def test_chunk_sizes_are_checked(bad):
    with pytest.raises(ValueError):
        chunking.ChunkSizes(*bad)


def test_chunk_index_skips_blank_pieces_and_tables_follow_their_body(spark):
    from folioflow.sources.documents import SECTION

    sections = [
        ("Intro", 1, "   ", 1, 1, [("Intro", [["", ""]], None), ("Intro", [["a", "b"], ["c"]], None)]),
        ("Impact", 1, "body", None, None, []),
    ]
    df = spark.createDataFrame([("d", sections)], f"document_id string, sections array<{SECTION}>")
    rows = chunking.chunk_documents(df).orderBy("chunk_index").collect()
    # a row of empty cells still renders its separator, so it is kept
    assert [(r["chunk_index"], r["text"], r["page"], r["char_start"]) for r in rows] == [
        (0, " | ", 1, None),
        (1, "a | b\nc", 1, None),
        (2, "body", None, 0),
    ]


def test_chunking_needs_no_shuffle(spark, capsys):
    from folioflow.sources.documents import SECTION

    df = spark.createDataFrame([], f"document_id string, sections array<{SECTION}>")
    chunking.chunk_documents(df).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan
