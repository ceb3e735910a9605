"""Citation audit of drafts: one array of findings per draft, computed inside its row.

No check needs another draft, so auditing any number of drafts is one map-only pass.
Marker numbers stay digit strings: an invented marker may be too long for any number type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.rows import unnest
from folioflow.functions.text import citation_markers, is_blank, let, lookup
from folioflow.operators.citations import citation_ids
from folioflow.operators.rendering import render

ERROR, WARNING = "error", "warning"
FINDINGS = "array<struct<severity: string, code: string, citation_id: string, message: string>>"


def _finding(severity: str, code: str, citation_id: Column | None, message: Column) -> Column:
    cid = F.lit(None).cast("string") if citation_id is None else citation_id
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        cid.alias("citation_id"),
        message.alias("message"),
    )


def _none() -> Column:
    return F.array().cast(FINDINGS)


def _one_if(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(_none())


def _about(cid: Column, text: str) -> Column:
    return F.concat(F.lit("Citation ["), cid, F.lit(f"] {text}"))


def _counts(values: Column) -> Column:
    """array<struct<value, n>> in order of first appearance."""
    return F.transform(
        F.array_distinct(values),
        lambda v: F.struct(
            v.alias("value"), F.size(F.filter(values, lambda o: o == v)).alias("n")
        ),
    )


def _count_of(values: Column, wanted: Column) -> Column:
    return F.size(F.filter(values, lambda v: v == wanted))


def field_findings(citations: Column) -> Column:
    """Missing status, programme, call or snippet, citation by citation."""

    def check(c: Column) -> Column:
        cid = c["citation_id"].cast("string")
        return F.concat(
            _one_if(
                c["source_status"].isNull(),
                _finding(ERROR, "missing_status", cid, _about(cid, "carries no source status.")),
            ),
            _one_if(
                is_blank(c["programme"]),
                _finding(ERROR, "empty_programme", cid, _about(cid, "names no programme.")),
            ),
            _one_if(
                is_blank(c["call_id"]),
                _finding(ERROR, "empty_call_id", cid, _about(cid, "names no call.")),
            ),
            _one_if(
                is_blank(c["snippet"]),
                _finding(WARNING, "empty_snippet", cid, _about(cid, "quotes nothing.")),
            ),
        )

    return F.flatten(F.transform(citations, check))


def id_findings(citations: Column) -> Column:
    """Repeated ids, one finding per id, and ids that are not exactly 1..N."""
    ids = F.transform(citations, lambda c: c["citation_id"])

    def check(xs: Column) -> Column:
        repeated = F.transform(
            F.filter(_counts(xs), lambda e: e["n"] > 1),
            lambda e: _finding(
                ERROR,
                "duplicate_citation_id",
                e["value"].cast("string"),
                F.concat(
                    _about(e["value"].cast("string"), "is listed "),
                    e["n"].cast("string"),
                    F.lit(" times."),
                ),
            ),
        )
        ordered = F.sort_array(xs)
        gap = (F.size(xs) > 0) & (ordered != F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1))))
        listing = F.array_join(F.transform(ordered, lambda i: i.cast("string")), ", ")
        return F.concat(
            repeated,
            _one_if(
                gap,
                _finding(
                    ERROR,
                    "non_sequential_citation_ids",
                    None,
                    F.concat(F.lit("Citation ids do not run 1..N: "), listing),
                ),
            ),
        )

    return let(ids, check)


def marker_findings(text: Column, citations: Column) -> Column:
    """Markers without a citation (one finding per occurrence), citations without a marker."""

    def check(both: Column) -> Column:
        markers, ids = both["markers"], both["ids"]
        dangling = F.transform(
            F.filter(markers, lambda m: ~F.array_contains(ids, m)),
            lambda m: _finding(
                ERROR,
                "marker_without_citation",
                m,
                F.concat(F.lit("Marker ["), m, F.lit("] names no citation.")),
            ),
        )
        unused = F.transform(
            F.filter(ids, lambda i: ~F.array_contains(markers, i)),
            lambda i: _finding(WARNING, "unused_citation", i, _about(i, "is never referenced.")),
        )
        return F.concat(dangling, unused)

    return let(
        F.struct(citation_markers(text).alias("markers"), citation_ids(citations).alias("ids")),
        check,
    )


def gate_findings(text: Column, citations: Column) -> Column:
    """Texts that must never ship: the no-evidence sentence and the stub placeholder."""
    return F.concat(
        _one_if(
            text.contains(vocab.NO_EVIDENCE_SENTENCE) & (F.size(citations) == 0),
            _finding(
                ERROR,
                "no_evidence_escape",
                None,
                F.lit("The draft admits it has no evidence and cites nothing."),
            ),
        ),
        _one_if(
            text.rlike(vocab.PLACEHOLDER_PATTERN),
            _finding(
                ERROR, "placeholder_text", None, F.lit("The draft holds stub placeholder text.")
            ),
        ),
    )


def render_findings(text: Column, citations: Column, rendered: Column) -> Column:
    """Badges the rendering lost, once per status, and inline markers it lost.

    The rendered body ends at the first references heading, as it does for a reader; a
    draft that contains that heading itself therefore loses its tail.
    """

    def check(b: Column) -> Column:
        firsts = F.filter(
            citations,
            lambda c, i: c["source_status"].isNotNull()
            & (
                F.array_position(
                    F.transform(citations, lambda o: F.coalesce(o["source_status"], F.lit(""))),
                    c["source_status"],
                )
                == i + 1
            ),
        )
        lost_badges = F.transform(
            F.filter(
                firsts,
                lambda c: ~F.coalesce(
                    rendered.contains(lookup(c["source_status"], vocab.STATUS_BADGE)), F.lit(False)
                ),
            ),
            lambda c: _finding(
                ERROR,
                "bad_render",
                c["citation_id"].cast("string"),
                F.concat(F.lit("No badge is shown for status "), c["source_status"]),
            ),
        )
        lost_markers = F.transform(
            F.filter(
                _counts(b["in_text"]), lambda e: _count_of(b["in_body"], e["value"]) < e["n"]
            ),
            lambda e: _finding(
                ERROR,
                "bad_render",
                e["value"],
                F.concat(F.lit("Inline marker ["), e["value"], F.lit("] was lost.")),
            ),
        )
        return F.concat(lost_badges, lost_markers)

    body = F.substring_index(rendered, vocab.REFERENCES_HEADING, 1)
    return let(
        F.struct(
            citation_markers(text).alias("in_text"), citation_markers(body).alias("in_body")
        ),
        check,
    )


def has_errors(findings: Column) -> Column:
    return F.exists(findings, lambda f: f["severity"] == ERROR)


def audit_drafts(drafts: DataFrame, rendered: bool = True) -> DataFrame:
    """Drafts with ``findings`` and ``passed``; ``rendered`` adds the rendering checks."""
    text, citations = F.col("text"), F.col("citations")
    parts = [
        field_findings(citations),
        id_findings(citations),
        marker_findings(text, citations),
        gate_findings(text, citations),
    ]
    if rendered:
        drafts = drafts if "rendered" in drafts.columns else render(drafts)
        parts.append(render_findings(text, citations, F.col("rendered")))
    return drafts.withColumn("findings", F.concat(*parts)).withColumn(
        "passed", ~has_errors(F.col("findings"))
    )


def finding_rows(audited: DataFrame) -> DataFrame:
    rows = unnest(audited, F.col("findings"), "draft_path", item="f")
    return rows.select(
        "draft_path", "f.severity", "f.code", "f.citation_id"
    )


def error_issues(audited: DataFrame) -> DataFrame:
    """Release-blocking findings only, one row each."""
    errors = F.filter("findings", lambda f: f["severity"] == ERROR)
    rows = unnest(audited, errors, "draft_path", "section_type", item="f")
    return rows.select(
        "draft_path", "section_type", "f.code", "f.citation_id", "f.message"
    )


def release_blocked(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.coalesce(F.bool_or(has_errors(F.col("findings"))), F.lit(False)).alias("blocked")
    )


def smoke_blocked(issues: DataFrame) -> DataFrame:
    """Whether any error other than the tolerated stub text exists."""
    return issues.agg(
        F.coalesce(
            F.bool_or(~F.col("code").isin(*vocab.SMOKE_TOLERATED_CODES)), F.lit(False)
        ).alias("blocked")
    )
