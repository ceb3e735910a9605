"""Deterministic JSON and Markdown reports from audit, pilot and benchmark tables.

Rows are rendered by the executors and written sorted, as a folder of part files in order;
no report passes through the driver.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioflow.functions.rows import unnest
from folioflow.functions.text import iso_utc, lookup
from folioflow.operators.lineage import materialise


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row, keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def table_row(*cells: Column) -> Column:
    shown = [F.coalesce(c.cast("string"), F.lit("n/a")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def _lines(part: int, key: Column, text: Column, df: DataFrame) -> DataFrame:
    return df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), text.alias("value"))


# fixed values: headings, labels and table heads of the release report
RELEASE_TITLE = "# Release Audit Report\n"
RELEASE_VERDICT = "**Verdict:** "
RELEASE_SUMMARY = "## Summary\n"
RELEASE_DIRECTORY = "- Audit directory: `{}`"
RELEASE_COUNTS = {
    "total_drafts": "- Total drafts on disk: ",
    "audited_drafts": "- Audited drafts: ",
    "passed_drafts": "- Passed drafts: ",
    "failed_drafts": "- Failed drafts: ",
    "citation_count": "- Citations audited: ",
    "unlabeled_citation_count": "- Unlabeled citations: ",
}
RELEASE_SAMPLE = ("- Sample size: ", "- Sample seed: ")
RELEASE_DRAFTS = "\n## Per-draft Results\n"
RELEASE_DRAFTS_HEAD = "| Status | Section | Citations | Draft |\n|--------|---------|-----------|-------|"
RELEASE_NO_DRAFTS = "_No drafts audited._"
RELEASE_CITATIONS = "\n## Citation Fidelity\n\n"
RELEASE_CITATIONS_HEAD = (
    "| Status | Programme | Call | Page | Section | Source | Chunk ID | Draft |\n"
    "|--------|-----------|------|------|---------|--------|----------|-------|"
)
RELEASE_NO_CITATIONS = "_No citations across audited drafts — investigate before shipping._"


def release_markdown(
    audited: DataFrame, directory: str, total_drafts: int | None = None, sample: tuple[int, int] | None = None
) -> DataFrame:
    """(part, key, value) lines of a release report, to be ordered by part and key.

    The drafts are audited and read once: their lines and, observed on the way, the totals come from the
    same pass, which is written to the shared folder. ``sample`` is the (size, seed) that picked the
    drafts out of ``total_drafts``.
    """
    unlabelled = F.size(F.filter("citations", lambda c: c["source_status"].isNull()))
    seen = Observation()
    watched = audited.observe(
        seen,
        F.count("*").alias("audited_drafts"),
        F.count_if("passed").alias("passed_drafts"),
        F.sum(F.size("citations").cast("bigint")).alias("citation_count"),
        F.sum(unlabelled.cast("bigint")).alias("unlabeled_citation_count"),
    )
    ticked = F.concat(F.lit("`"), F.col("draft_path"), F.lit("`"))
    badge = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    per_draft = F.struct(
        F.lit(1).alias("part"), F.col("draft_path").alias("key"),
        table_row(badge, F.col("section_type"), F.size("citations"), ticked).alias("value"),
    )

    def per_citation(c: Column) -> Column:
        return F.struct(
            F.lit(3).alias("part"),
            F.concat(F.col("draft_path"), F.format_string("%012d", c["citation_id"])).alias("key"),
            table_row(
                F.coalesce(c["source_status"], F.lit("unknown")), c["programme"], c["call_id"], c["page"],
                F.nullif(c["section_heading"], F.lit("")),
                F.coalesce(F.nullif(c["proposal_title"], F.lit("")), F.lit("untitled")), c["chunk_id"], ticked,
            ).alias("value"),
        )

    rows = unnest(watched, F.concat(F.array(per_draft), F.transform("citations", per_citation)), item="line")
    lines = materialise(rows.select("line.*"))
    counts = {name: value or 0 for name, value in seen.get.items()}
    counts["failed_drafts"] = counts["audited_drafts"] - counts["passed_drafts"]
    counts["total_drafts"] = counts["audited_drafts"] if total_drafts is None else total_drafts
    head = [
        RELEASE_TITLE,
        RELEASE_VERDICT + ("FAIL" if counts["failed_drafts"] else "PASS") + "\n",
        RELEASE_SUMMARY,
        RELEASE_DIRECTORY.format(directory),
        *[f"{label}{counts[name]}" for name, label in RELEASE_COUNTS.items()],
        *([f"{label}{value}" for label, value in zip(RELEASE_SAMPLE, sample, strict=True)] if sample else []),
        RELEASE_DRAFTS,
        RELEASE_DRAFTS_HEAD if counts["audited_drafts"] else RELEASE_NO_DRAFTS,
    ]
    middle = RELEASE_CITATIONS + (RELEASE_CITATIONS_HEAD if counts["citation_count"] else RELEASE_NO_CITATIONS)
    fixed = audited.sparkSession.createDataFrame([(0, "", "\n".join(head)), (2, "", middle)], "part int, key string, value string")
    return fixed.union(lines)


# fixed values: headings and notes of the pilot report
PILOT_SECTIONS_HEAD = (
    "## Generated sections (AC1)\n\n"
    "| # | Section | Citations | Draft length (chars) | Elapsed (ms) | Audit | Artefact |\n"
    "|---|---------|-----------|----------------------|--------------|-------|----------|"
)
PILOT_RATINGS_HEAD = (
    "\n## Coordinator satisfaction (AC2)\n\n"
    "| Section | Coordinator | Rating (1-5) | Time saved (min) | Notes |\n"
    "|---------|-------------|--------------|------------------|-------|"
)
PILOT_NO_RATINGS = (
    "| _all_ | `<pending>` | `<pending>` | `<pending>` | "
    "_smoke-mode run — no coordinator ratings yet_ |"
)
PILOT_ISSUES_HEAD = "\n## Citation issues (AC3)\n"
PILOT_NO_ISSUES = "_No release-blocking citation issues found._"
PILOT_ISSUES_TABLE = (
    "| Section | Code | Message | Draft |\n|---------|------|---------|-------|"
)
PILOT_TITLE = "# MVP Pilot Validation Report\n"
PILOT_HEAD = {
    "mode": "- **Mode:** `{}`",
    "call_id": "- **Call ID:** `{}`",
    "proposal_title": "- **Proposal:** {}",
    "generated_at": "- **Generated at (UTC):** {}",
    "verdict": "- **Verdict:** **{}**",
    "notes": "- **Notes:** {}",
}
PILOT_AUDIT = "\n- Audit summary: {passed_drafts} passed, {failed_drafts} failed of {audited_drafts} audited ({citation_count} citations).\n"
PILOT_PERFORMANCE_HEAD = "## Performance (AC3)\n"
PILOT_RUNTIME = "- Runtime: `{runtime}` (LLM `{llm_model}`, embedder `{embedder}`)\n- Platform: `{platform}`"
PILOT_INDEXING = "- Indexing: {chunk_count} chunks in {elapsed_ms} ms ({chunks_per_second} chunks/sec)"
PILOT_RETRIEVAL = "- Retrieval (top-{top_k}, {query_count} queries): avg {elapsed_ms_avg} ms / p95 {elapsed_ms_p95} ms"
PILOT_GENERATION = "- Generation ({section_type}): {elapsed_ms} ms, {citation_count} citations, prompt {prompt_length} chars"
PILOT_SMOKE_HEAD = "\n## Network isolation smoke (AC3)\n\n"
PILOT_SMOKE = "- Verdict: **{}** (exit code {})"
PILOT_SMOKE_DETAIL = "\n- Detail: {}"
PILOT_VERDICT_HEAD = "\n\n## Go / No-Go recommendation (AC3)\n\n"
# the advice below each verdict; its prose is this library's own
PILOT_ADVICE = {
    "conditional": "> The pipeline held in smoke mode, but nobody has rated the drafts yet: run a coordinator pilot before the release.",
    "no_go": "> Do not release: an invariant failed, see the issues and the smoke verdict above.",
    "go": "> Release: ratings cleared the floor, and audit and network checks held.",
}


def fill(pattern: str, **values: Column) -> Column:
    """The pattern with named columns put in; null if one of them is."""
    parts = []
    for text, name, _, _ in Formatter().parse(pattern):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def pilot_markdown(
    pilots: DataFrame, sections: DataFrame, ratings: DataFrame, issues: DataFrame
) -> DataFrame:
    """(pilot_id, part, key, value) lines of one report per pilot.

    ``pilots`` (pilot_id, mode, call_id, proposal_title, generated_at, verdict, notes, smoke_passed,
    smoke_exit_code, smoke_detail; audit: struct<audited_drafts, passed_drafts, failed_drafts,
    citation_count>; runtime: struct<runtime, llm_model, embedder, platform>; indexing:
    struct<chunk_count, elapsed_ms, chunks_per_second>; retrieval: struct<top_k, query_count,
    elapsed_ms_avg, elapsed_ms_p95>; generation: struct<section_type, elapsed_ms, citation_count,
    prompt_length>), ``sections`` (pilot_id, section_pos, section_type, citation_count,
    draft_length, elapsed_ms, audit_passed, draft_path), ``ratings`` (pilot_id, rating_id, section_type,
    coordinator_id, rating, time_saved_minutes, notes), ``issues`` (pilot_id, section_type, code, message,
    draft_path). What is not there yet is shown as pending; notes, details and measurements that are
    null have no line.
    """

    def lines(part: int, key: Column, text: Column, df: DataFrame) -> DataFrame:
        return df.select(
            "pilot_id", F.lit(part).alias("part"), key.cast("string").alias("key"), text.alias("value")
        )

    def ticks(c: str) -> Column:
        return F.concat(F.lit("`"), F.col(c), F.lit("`"))

    def has(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("pilot_id").agg(F.lit(True).alias(name))

    pending = F.lit("<pending>")
    known = pilots.join(has(ratings, "rated"), "pilot_id", "left").join(
        has(issues, "flawed"), "pilot_id", "left"
    )
    shown = {
        "mode": F.col("mode"), "call_id": F.col("call_id"), "proposal_title": F.col("proposal_title"),
        "generated_at": iso_utc(F.col("generated_at")), "verdict": F.upper("verdict"),
        "notes": F.nullif(F.col("notes"), F.lit("")),
    }
    named = [fill(pattern.replace("{}", "{x}"), x=shown[name]) for name, pattern in PILOT_HEAD.items()]
    head = F.concat(F.concat_ws("\n", F.lit(PILOT_TITLE), *named), F.lit("\n\n" + PILOT_SECTIONS_HEAD))
    section = table_row(
        F.col("section_pos") + 1,
        F.col("section_type"),
        F.col("citation_count"),
        F.col("draft_length"),
        F.col("elapsed_ms"),
        F.when(F.col("audit_passed"), "PASS").otherwise("FAIL"),
        ticks("draft_path"),
    )
    ratings_head = F.concat_ws(
        "\n", F.lit(PILOT_RATINGS_HEAD), F.when(F.col("rated").isNull(), F.lit(PILOT_NO_RATINGS))
    )
    rating = table_row(
        F.col("section_type"),
        F.col("coordinator_id"),
        F.coalesce(F.col("rating").cast("string"), pending),
        F.coalesce(F.col("time_saved_minutes").cast("string"), pending),
        F.coalesce("notes", F.lit("")),
    )
    issues_head = F.concat_ws(
        "\n",
        F.lit(PILOT_ISSUES_HEAD),
        F.when(F.col("flawed"), F.lit(PILOT_ISSUES_TABLE)).otherwise(F.lit(PILOT_NO_ISSUES)),
    )
    issue = table_row(F.col("section_type"), ticks("code"), F.col("message"), ticks("draft_path"))

    def measured(pattern: str, struct: str) -> Column:
        names = [name for _, name, _, _ in Formatter().parse(pattern) if name]
        one_place = ("chunks_per_second", "elapsed_ms_avg")
        values = {n: F.col(struct)[n] for n in names}
        return fill(pattern, **{n: F.format_string("%.1f", F.bround(v.cast("double"), 1)) if n in one_place else v for n, v in values.items()})

    advice = lookup(F.col("verdict"), PILOT_ADVICE)
    detail = F.coalesce(fill(PILOT_SMOKE_DETAIL.replace("{}", "{x}"), x=F.nullif(F.col("smoke_detail"), F.lit(""))), F.lit(""))
    badge = F.when(F.col("smoke_passed"), "PASS").otherwise("FAIL")
    tail = F.concat(
        F.concat_ws(
            "\n",
            measured(PILOT_AUDIT, "audit"),
            F.lit(PILOT_PERFORMANCE_HEAD),
            measured(PILOT_RUNTIME, "runtime"),
            F.when(F.col("indexing").isNotNull(), measured(PILOT_INDEXING, "indexing")),
            F.when(F.col("retrieval").isNotNull(), measured(PILOT_RETRIEVAL, "retrieval")),
            F.when(F.col("generation").isNotNull(), measured(PILOT_GENERATION, "generation")),
            F.concat(
                F.lit(PILOT_SMOKE_HEAD), fill(PILOT_SMOKE.replace("{}", "{x}", 1).replace("{}", "{y}"), x=badge, y=F.col("smoke_exit_code")),
                detail, F.lit(PILOT_VERDICT_HEAD + "**"), F.upper("verdict"), F.lit("**\n\n"), advice,
            ),
        )
    )
    none = F.lit("")
    rating_key = F.concat_ws("/", "section_type", F.format_string("%012d", "rating_id"))
    issue_key = F.concat_ws("/", "section_type", "draft_path", "code")
    return (
        lines(0, none, head, pilots)
        .union(lines(1, F.format_string("%06d", "section_pos"), section, sections))
        .union(lines(2, none, ratings_head, known))
        .union(lines(3, rating_key, rating, ratings))
        .union(lines(4, none, issues_head, known))
        .union(lines(5, issue_key, issue, issues))
        .union(lines(6, none, tail, pilots))
    )


def write_report(lines: DataFrame, path: str, *order: str) -> None:
    """Write report lines in order; the part files, read by name, are the report."""
    lines.orderBy(*order).select("value").write.mode("errorifexists").text(path)
