from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.operators import audit, citations, iterations, latency, ratings, release, rendering
from folioflow.operators.citations import CITATION

DRAFT = f"draft_path string, section_type string, text string, citations array<{CITATION}>"


def _cite(i, status="funded", programme="cef", call="C-1", title="T", heading="H", page=3, snippet="s"):
    return (i, status, programme, call, title, heading, page, f"k{i}", snippet)


def _audit(spark, text, cites, rendered=True):
    df = spark.createDataFrame([("d", "impact_pathway", text, cites)], DRAFT)
    row = audit.audit_drafts(df, rendered=rendered).first()
    return [(f["code"], f["citation_id"]) for f in row["findings"]], row["passed"]


def test_clean_draft_passes(spark):
    assert _audit(spark, "see [1] and [2]", [_cite(1), _cite(2, "rejected")]) == ([], True)


@pytest.mark.parametrize(
    "cite, code, passes",
    [
        (_cite(1, status=None), "missing_status", False),
        (_cite(1, programme=" "), "empty_programme", False),
        (_cite(1, programme=None), "empty_programme", False),
        (_cite(1, call=""), "empty_call_id", False),
        (_cite(1, snippet="\n"), "empty_snippet", True),
    ],
)
def test_field_findings(spark, cite, code, passes):
    found, passed = _audit(spark, "[1]", [cite], rendered=False)
    assert found == [(code, "1")] and passed is passes


def test_duplicates_also_break_the_sequence(spark):
    found, _ = _audit(spark, "[1]", [_cite(1), _cite(1)])
    assert found == [("duplicate_citation_id", "1"), ("non_sequential_citation_ids", None)]
    found, _ = _audit(spark, "[1][3]", [_cite(3), _cite(1)])
    assert found == [("non_sequential_citation_ids", None)]


def test_every_dangling_occurrence_is_a_finding(spark):
    found, passed = _audit(spark, "[1] [100] [100] [99999999999999999999999]", [_cite(1)])
    assert [f for f in found if f[0] == "marker_without_citation"] == [
        ("marker_without_citation", "100"),
        ("marker_without_citation", "100"),
        ("marker_without_citation", "99999999999999999999999"),
    ]
    assert not passed


def test_unused_citation_only_warns(spark):
    assert _audit(spark, "none", [_cite(1)]) == ([("unused_citation", "1")], True)


def test_gates(spark):
    assert _audit(spark, f"x. {vocab.NO_EVIDENCE_SENTENCE}", [])[0] == [("no_evidence_escape", None)]
    assert _audit(spark, f"[1] {vocab.NO_EVIDENCE_SENTENCE}", [_cite(1)]) == ([], True)
    text = "This sentence references retrieved example [1] as supporting evidence"
    assert _audit(spark, text, [_cite(1)])[0] == [("placeholder_text", None)]


def test_draft_with_its_own_references_heading_loses_markers(spark):
    found, _ = _audit(spark, "[1]\n## References\n[1]", [_cite(1)])
    assert found == [("bad_render", "1")]


def test_lost_badge_is_reported_once_per_status(spark):
    df = spark.createDataFrame([("d", "impact", "[1][2]", [_cite(1), _cite(2)])], DRAFT)
    row = audit.audit_drafts(df.withColumn("rendered", F.lit("[1][2]"))).first()
    assert [(f["code"], f["citation_id"]) for f in row["findings"]] == [("bad_render", "1")]


def test_rendering(spark):
    cites = [_cite(1, call="A|B"), _cite(2, "esr_note", title="", heading=None, page=None)]
    df = spark.createDataFrame([("d", "impact_pathway", "body [1] \n", cites)], DRAFT)
    assert rendering.render(df).first()["rendered"] == (
        "# Impact Pathway\n\nbody [1]\n\n## References\n\n"
        "| # | Status | Programme | Call | Section | Page | Source |\n"
        "|---|--------|-----------|------|---------|------|--------|\n"
        "| 1 | FUNDED | Cef | A\\|B | H | 3 | T |\n"
        "| 2 | ESR NOTE | Cef | C-1 | n/a | n/a | untitled |\n\n"
        "### Notes\n\n"
        "- [1] ✓ FUNDED — Cef call A|B, p. 3, §H\n"
        "- [2] ⓘ ESR ADVISORY — Cef call C-1, p. n/a, §n/a\n"
        "  _Reviewer commentary — advisory only, not ground truth._\n"
    )
    empty = spark.createDataFrame([("d", "other", "x", [])], DRAFT)
    assert rendering.render(empty).first()["rendered"].endswith("## References\n\n_No citations._\n")


def test_evidence_text(spark):
    rows = [([_cite(1), _cite(2, "esr_note", heading="", page=None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"c array<{CITATION}>")
    got = [r[0] for r in df.select(citations.evidence_text(F.col("c"))).collect()]
    assert got[0] == (
        "[1] **FUNDED** — Cef call C-1, p. 3, §H\n    > s\n\n"
        "[2] **ESR NOTE** — Cef call C-1, p. ?, §(no section heading)\n    > s"
    )
    assert got[1:] == ["(no examples retrieved)"] * 2


def test_marker_check_uses_bounded_markers(spark):
    rows = [("d", "impact", "[3] [0] [3] [100]", [_cite(1)]), ("e", "impact", "none", [])]
    got = citations.marker_check(spark.createDataFrame(rows, DRAFT)).collect()
    assert [(r["invalid_markers"], r["valid"], r["no_markers"]) for r in got] == [
        ([0, 3], False, False),
        ([], True, True),
    ]


def test_release_totals_and_sample(spark):
    rows = [
        ("a", "impact", "[1]", [_cite(1)]),
        ("b", "impact", "[1]", [_cite(1, status=None)]),
        ("c", "impact", "x", []),
    ]
    drafts = spark.createDataFrame(rows, DRAFT)
    totals = release.release_totals(audit.audit_drafts(drafts), drafts).first().asDict()
    assert totals == {
        "audited_drafts": 3,
        "passed_drafts": 2,
        "failed_drafts": 1,
        "citation_count": 2,
        "unlabeled_citation_count": 1,
        "passed": False,
        "total_drafts": 3,
    }
    nothing = release.release_totals(audit.audit_drafts(drafts.limit(0))).first()
    assert nothing["passed"] is True and nothing["citation_count"] == 0
    two = {r["draft_path"] for r in release.sample_drafts(drafts, 2).collect()}
    again = {r["draft_path"] for r in release.sample_drafts(drafts.repartition(3), 2).collect()}
    assert len(two) == 2 and two == again
    assert release.sample_drafts(drafts, 9).count() == 3
    with pytest.raises(ValueError):
        release.sample_drafts(drafts, 0)


def test_issues_and_smoke_tolerance(spark):
    rows = [("a", "impact", "This sentence references retrieved example [1] as supporting evidence", [_cite(1)])]
    a = audit.audit_drafts(spark.createDataFrame(rows, DRAFT))
    issues = audit.error_issues(a)
    assert [r["code"] for r in issues.collect()] == ["placeholder_text"]
    assert audit.smoke_blocked(issues).first()[0] is False
    assert audit.release_blocked(a).first()[0] is True
    assert audit.smoke_blocked(issues.limit(0)).first()[0] is False


@pytest.mark.parametrize(
    "chars, cites, expected",
    [
        (0, 0, vocab.CHANGE_NONE + " text +0 chars, citations +0."),
        (5, -1, vocab.CHANGE_GROWN + " text +5 chars, citations -1."),
        (0, 2, vocab.CHANGE_SHRUNK + " text +0 chars, citations +2."),
        (-3, 0, vocab.CHANGE_SHRUNK + " text -3 chars, citations +0."),
    ],
)
def test_change_summary(one, chars, cites, expected):
    assert one(iterations.changes_summary(F.col("a"), F.col("b")), "a int, b int", chars, cites) == expected


def test_iteration_cap():
    assert iterations.checked_cap(10) == 5
    for bad in (0, 1):
        with pytest.raises(ValueError):
            iterations.checked_cap(bad)


def test_critique_cap(one):
    cut = one(iterations.cap_critique(F.col("x")), "x string", "a" * 4001)
    assert len(cut) == 4000 and cut.endswith("…")
    assert one(iterations.cap_critique(F.col("x")), "x string", " \n") == vocab.EMPTY_CRITIQUE


def test_requirements_are_trimmed_distinct_and_ordered(one):
    build = iterations.requirements_checked(F.col("o"), F.col("s"))
    got = one(build, "o array<string>, s array<string>", [" b ", "a", "b", " "], ["impact"])
    assert got == ["default-section-guidance", "b", "a", "topic:impact"]
    assert one(build, "o array<string>, s array<string>", None, None) == ["default-section-guidance"]


@pytest.mark.parametrize(
    "values, expected", [([42], 42), ([10] * 4, 10), (list(range(1, 101)), 95), ([0, 50], 48), ([0, 10], 10)]
)
def test_p95(spark, values, expected):
    # 0.95 * 50 = 47.5 rounds to 48 and 9.5 to 10: half goes to even
    rows = [(v, 1) for v in values] + [(None, 3)]
    df = spark.createDataFrame(rows, "elapsed_ms int, result_count int").repartition(3)
    row = latency.latency_rollup(df.withColumn("probe", F.lit("p")), "probe").first()
    assert (row["elapsed_ms_p95"], row["query_count"]) == (expected, len(rows))


def test_no_task_holds_all_distinct_values(spark):
    """Two probes, one of 300,000 distinct values: its ranges are spread, and the ranks are exact."""
    rows = spark.range(300_000).select((F.col("id") * 7919 % 300_007).cast("int").alias("elapsed_ms"), F.lit("big").alias("probe"))
    rows = rows.union(spark.range(11).select((F.col("id") * 10).cast("int"), F.lit("small")))
    sizes = latency._ranged_counts(rows, ("probe",), "elapsed_ms").groupBy("part").agg(F.count("*").alias("n")).collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) < 200_000
    found = {r["probe"]: r["percentile"] for r in latency.exact_percentile(rows, ("probe",), "elapsed_ms", 95).collect()}
    values = sorted(i * 7919 % 300_007 for i in range(300_000))
    rank = 95 * (len(values) - 1)
    low, weight = divmod(rank, 100)
    assert found == {"big": (values[low] * (100 - weight) + values[low + 1] * weight) / 100, "small": 95.0}


def test_throughput_zero_guards(spark):
    df = spark.createDataFrame([(0, 0, 0), (4, 20, 10)], "proposal_count int, chunk_count int, elapsed_ms int")
    got = [(r["per_proposal_ms_avg"], r["chunks_per_second"]) for r in latency.indexing_throughput(df).collect()]
    assert got == [(0.0, 0.0), (2.5, 2000.0)]


def test_verdict_depends_on_section_order(spark):
    pilots = spark.createDataFrame(
        [(p, m, s, a, b) for p, m, s, a, b in [
            (1, "coordinator", True, True, False),
            (2, "coordinator", True, True, False),
            (3, "coordinator", True, True, False),
            (4, "smoke", True, False, False),
            (5, "smoke", True, True, True),
            (6, "coordinator", False, True, False),
            (7, "coordinator", True, False, False),
        ]],
        "pilot_id bigint, mode string, smoke_passed boolean, audit_passed boolean, smoke_blocking boolean",
    )
    sections = spark.createDataFrame(
        [(1, 0, "impact"), (1, 1, "ethics"), (2, 0, "impact"), (2, 1, "ethics")],
        "pilot_id bigint, section_pos int, section_type string",
    )
    rated = spark.createDataFrame(
        [(1, "ethics", 2), (2, "impact", 3), (2, "impact", None), (2, "nowhere", 5)],
        "pilot_id bigint, section_type string, rating int",
    )
    known, unknown = ratings.attach_ratings(sections, rated)
    assert unknown.count() == 1 and known.count() == 3
    got = ratings.verdicts(pilots, ratings.section_outcomes(sections, known)).collect()
    assert {r["pilot_id"]: r["verdict"] for r in got} == {
        1: "conditional",
        2: "no_go",
        3: "go",
        4: "conditional",
        5: "no_go",
        6: "no_go",
        7: "no_go",
    }
