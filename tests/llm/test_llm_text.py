"""Line dedup, Jaccard join, decontamination and license scans on small tables."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import deduplicated, jaccard_components, overlapping, shingle_set

from folioflow.llm import decontamination, jaccard, licenses, line_dedup, shared, sketch

SCHEMA = "doc_id bigint, text string, n_lines string, cut string, fp int, w string, score string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "s") for i, t in rows], SCHEMA)


def sentence(rng, size):
    return " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(size))


def test_word_and_shingle_fingerprints_equal_words_split_in_python():
    texts = ["", None, "One two\tTWO  one", " a\nb\vc\fd\re ", "é É ﬁ", "x" * 5000 + " y", "lone"]
    column = pa.array(["skipped", *texts]).slice(1)
    hashes, counts = shared.word_hashes(column)
    assert counts.tolist() == [0, 0, 4, 5, 3, 2, 1]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[9] != hashes[10]
    found, per_row = shared.shingle_hashes(hashes, counts, 4)
    assert per_row.tolist() == [0, 0, 1, 2, 1, 1, 1]
    assert len(np.unique(found)) == len(found)


def test_a_set_filter_holds_its_set(spark):
    rows = spark.range(0, 3000, 3)
    held = sketch.set_filter(rows, 1000)
    answers = sketch.may_hold(held, np.arange(3000))
    assert answers[::3].all() and answers.mean() < 0.5
    assert not sketch.may_hold(sketch.set_filter(rows.where("id < 0"), 0), np.arange(9)).any()


def edge_rows(rng):
    run = "\n".join(sentence(rng, 20) for _ in range(4))  # 80 words in four lines
    one = sentence(rng, 60)
    return [
        (5, None), (6, ""), (7, "\n\n \n"), (8, sentence(rng, 5)),
        (10, f"{sentence(rng, 9)}\n{run}\n{sentence(rng, 12)}"),
        (11, f"{run}\n\n{sentence(rng, 7)}"),
        (12, f"{sentence(rng, 30)}\n{one}"), (13, f"{one}\n{sentence(rng, 30)}"), (14, one), (14, one),
        (15, "\n".join(["same words in each line"] * 40)),
        (16, "\n".join(["tiny"] * 120)),
        (17, "\n".join(run.split("\n")[1:])), (18, run.split("\n")[0]),
        (19, sentence(rng, 20000)), (None, run), (None, None),
    ]


def test_line_dedup_equals_brute_force_and_keeps_rows(spark):
    rows = edge_rows(random.Random(3))
    documents = table(spark, rows)
    out = line_dedup.deduplicated_documents(documents, shared.Scratch(spark)).collect()
    assert len(out) == len(rows)
    expected = deduplicated({i: t for i, t in rows if i is not None})
    for row in out:
        if row["doc_id"] is not None:
            assert row["text"] == expected[row["doc_id"]], row["doc_id"]
            given = dict(rows)[row["doc_id"]]
            assert row["n_lines"] == (0 if given is None else len(given.split("\n")))
            assert (row["cut"], row["score"]) == ("y", "s")
    assert [r["text"] for r in out if r["doc_id"] is None and r["text"]] == [rows[-2][1]]
    empty = line_dedup.deduplicated_documents(table(spark, []), shared.Scratch(spark))
    assert empty.count() == 0


def near_rows(rng):
    rows = []
    for group in range(6):
        words = sentence(rng, 120).split()
        rows += [(100 * group + 50, " ".join(words)), (100 * group + 3, "  ".join(words).upper())]
        for copy in range(8):
            other = list(words)
            for at in rng.sample(range(120), rng.randint(1, 9)):
                other[at] = "".join(rng.choices("xyz", k=6))
            rows.append((100 * group + 10 + copy, " ".join(other)))
    shared_part = sentence(rng, 60)
    rows += [(1000 + i, f"{shared_part} {sentence(rng, 10 + i)}") for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "Two  WORDS"), (2005, "two words more")]
    rows += [(2006, sentence(rng, 15000)), (7, "two words"), (7, "two words")]
    return rows


def test_jaccard_join_equals_brute_force(spark):
    rows = near_rows(random.Random(4))
    expected = jaccard_components(dict(rows))
    out = jaccard.jaccard_groups(table(spark, [*rows, (None, "two words")]), shared.Scratch(spark)).collect()
    assert len(out) == len(rows) + 1
    for row in out:
        i = row["doc_id"]
        if i is None:
            assert (row["n_shingles"], row["component_id"]) == (1, None)
        else:
            assert (row["n_shingles"], row["component_id"]) == (len(shingle_set(dict(rows)[i])), expected[i])
    kept = jaccard.jaccard_kept(table(spark, rows), shared.Scratch(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if expected[i] == i)
    assert jaccard.jaccard_groups(table(spark, []), shared.Scratch(spark)).count() == 0


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, both in ((0, 1, 0), (500, 500, 430), (70, 60, 55), (3000, 2800, 2700), (40, 9, 9)):
        values = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        left, right = np.unique(values[:n]), np.unique(np.concatenate([values[:both], values[n : n + m - both]]))
        bound = jaccard.least_difference(jaccard.parity_sketch(left), jaccard.parity_sketch(right))
        assert bound <= len(np.setxor1d(left, right))


def test_masks_find_every_window_with_three_substitutions():
    places = range(decontamination.WINDOW)
    for wrong in itertools.combinations(places, 3):
        assert any(
            all(start + o not in wrong for o in mask)
            for mask in decontamination.MASKS
            for start in range(decontamination.WINDOW - mask[-1])
        )


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    items = {i: sentence(rng, n) for i, n in enumerate((10, 12, 16, 25, 60, 9, 3000))}
    rows = [(1, None), (2, ""), (3, sentence(rng, 4)), (None, items[3])]
    for i, text in items.items():
        words = text.split()
        some = words[len(words) // 3 : len(words) // 3 + 30]
        for changes in (0, 2, 5, 9):
            other = list(some)
            for at in rng.sample(range(len(other)), min(changes, len(other))):
                other[at] = "changed"
            rows.append((100 * i + changes + 10, f"{sentence(rng, 20)}. {', '.join(other).upper()}! {sentence(rng, 8)}"))
    rows.append((rows[-1][0], rows[-1][1]))
    benchmark = spark.createDataFrame(
        [*items.items(), (50, items[3]), (51, None), (52, ""), (None, items[4])], "item_id bigint, text string"
    )
    documents = table(spark, rows)
    out = decontamination.overlaps(documents, benchmark).collect()
    expected = overlapping({i: t for i, t in rows if i is not None}, items)
    assert {(r["doc_id"], r["item_id"]) for r in out} == expected and len(out) == len(expected)
    assert all(100 * r["agreeing"] >= 80 * r["compared"] for r in out)
    kept = decontamination.clean_documents(documents, benchmark, shared.Scratch(spark)).collect()
    dirty = {i for i, _ in expected}
    assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(str(i) for i, _ in rows if i not in dirty)
    nothing = benchmark.where("item_id < 0")
    assert decontamination.overlaps(documents, nothing).count() == 0
    assert decontamination.overlaps(table(spark, []), benchmark).count() == 0


def test_license_scan_finds_whole_and_changed_notices(spark):
    rng = random.Random(6)
    notice = licenses.TEMPLATES["mit-permission"].split()
    changed = list(notice)
    changed[10] = changed[50] = "other"
    half = " ".join(notice[: len(notice) // 2])
    rows = [
        (1, f"{sentence(rng, 200)} {' '.join(notice)} {sentence(rng, 5)}"), (2, " ".join(changed).upper()), (3, half),
        (4, "Released under the MIT License."), (5, "released, under the\nMIT -- license"), (6, "Released under the"),
        (7, None), (8, ""), (None, "Released under the MIT License."), (9, sentence(rng, 20000)), (4, "Released under the MIT License."),
    ]
    out = licenses.license_matches(table(spark, rows)).collect()
    found = sorted((str(r["doc_id"]), r["template"]) for r in out)
    line = "mit-line"
    assert found == sorted(
        [("1", "mit-permission"), ("2", "mit-permission"), ("4", line), ("4", line), ("5", line), ("None", line)]
    )
    assert {r["start_word"] for r in out if r["doc_id"] == 1} == {200}
    assert licenses.license_matches(table(spark, [])).count() == 0


def test_full_licence_texts_with_edits_are_found(spark):
    """Whole texts survive a few changed words, wherever they stand; the other licences of a family are told apart."""
    rng = random.Random(16)
    rows, expected = [], set()
    for n, name in enumerate(sorted(licenses.TEMPLATES)):
        words = licenses.TEMPLATES[name].split()
        for place in rng.sample(range(len(words)), len(words) // 60):
            words[place] = "edited"
        rows.append((n, f"{sentence(rng, rng.randrange(90))} {' '.join(words)} {sentence(rng, rng.randrange(90))}"))
        expected.add((n, name))
    found = {(r["doc_id"], r["template"]) for r in licenses.license_matches(table(spark, rows)).collect()}
    assert len(licenses.TEMPLATES) >= 30 and expected <= found
    names = sorted(licenses.TEMPLATES)
    families = {n: {t.split("-")[0] for d, t in found if d == n} for n in range(len(names))}
    assert families[names.index("mit")] == {"mit"} and families[names.index("zlib")] == {"zlib"}


def test_windows_stay_within_their_text():
    per_row = np.array([0, 3, 4, 9, 10, 0, 23])
    for size in (1, 2, 4, 8):
        starts, row = licenses.windows(per_row, size)
        begin = np.cumsum(per_row) - per_row
        assert (starts >= begin[row]).all() and (starts + size <= begin[row] + per_row[row]).all()
        covered = {p for s in starts.tolist() for p in range(s, s + size)}
        assert covered == {p for b, n in zip(begin.tolist(), per_row.tolist(), strict=True) if n >= size for p in range(b, b + n)}


@pytest.mark.parametrize("size", [1, 3, 8, 70])
def test_window_sizes_leave_three_windows_in_a_template(size):
    assert licenses.window_size(size) <= max(1, size // 2)
