"""Closed vocabularies, word lists, patterns and text formats.

Everything here is a fixed value: results are only right when these equal the agreed
vocabulary, so they are stated as plain text in one place.
"""

from __future__ import annotations

# --- fixed values: enumerations -------------------------------------------------------

SOURCE_STATUSES = ("funded", "rejected", "esr_note", "unknown")

PROGRAMMES = ("horizon_europe", "horizon_2020", "digital_europe", "cef", "other")

SECTION_TYPES = (
    "excellence",
    "impact",
    "implementation",
    "methodology",
    "impact_pathway",
    "work_plan",
    "consortium",
    "budget",
    "ethics",
    "dissemination",
    "other",
)

STATUS_PRIORITY = {"funded": 0, "rejected": 1, "esr_note": 2, "unknown": 3}

# --- fixed values: heading rules (first hit wins) ---------------------------------------

SECTION_TYPE_RULES = (
    ("impact pathway", "impact_pathway"),
    ("excellence", "excellence"),
    ("methodology", "methodology"),
    ("work plan", "work_plan"),
    ("workplan", "work_plan"),
    ("implementation", "implementation"),
    ("consortium", "consortium"),
    ("partners", "consortium"),
    ("budget", "budget"),
    ("resources", "budget"),
    ("ethics", "ethics"),
    ("dissemination", "dissemination"),
    ("exploitation", "dissemination"),
    ("impact", "impact"),
)

# --- fixed values: chunking -------------------------------------------------------------

BREAK_MARKERS = ("\n\n", ". ", "? ", "! ")
TARGET_CHARS = 1200
OVERLAP_CHARS = 200
MIN_CHUNK_CHARS = 200
BREAK_TOLERANCE = 100
NO_SECTION = "__no_section__"

# --- fixed values: embedding and retrieval policy ------------------------------------------

HASH_EMBEDDING_DIM = 384
OVER_FETCH = 4
MAX_CANDIDATES = 100

REASON_BY_STATUS = {
    "funded": "funded_primary",
    "rejected": "rejected_threshold_met",
    "esr_note": "esr_advisory",
    "unknown": "unknown_low_confidence",
}
REASON_LESSONS = "lessons_learned_mode"
REASON_FALLBACK_SUFFIX = "_section_type_fallback"

# --- fixed values: call and topic text ------------------------------------------------------

PROGRAMME_ALIASES = {
    "H2020": "horizon_2020",
    "HORIZON-2020": "horizon_2020",
    "HORIZON_2020": "horizon_2020",
    "HE": "horizon_europe",
    "HORIZON-EUROPE": "horizon_europe",
    "HORIZON_EUROPE": "horizon_europe",
    "HORIZON-CL0": "horizon_europe",
    "HORIZON-CL1": "horizon_europe",
    "HORIZON-CL2": "horizon_europe",
    "HORIZON-CL3": "horizon_europe",
    "HORIZON-CL4": "horizon_europe",
    "HORIZON-CL5": "horizon_europe",
    "HORIZON-CL6": "horizon_europe",
    "HORIZON-CL7": "horizon_europe",
    "HORIZON-CL8": "horizon_europe",
    "HORIZON-CL9": "horizon_europe",
}
PROGRAMME_TOKEN = r"HORIZON[-_](?:EUROPE|2020|CL\d)|H2020|HE"
CALL_ID_STOP_TOKENS = (
    "PART",
    "PARTB",
    "SECTION",
    "SEALED",
    "PROPOSAL",
    "SUBMITTED",
    "FINAL",
    "DRAFT",
    "ANNEX",
)
GUIDANCE_HEADINGS = {
    "methodology guidance": "methodology",
    "impact guidance": "impact",
    "impact pathway guidance": "impact_pathway",
    "excellence guidance": "excellence",
    "implementation guidance": "implementation",
    "work plan guidance": "work_plan",
    "consortium guidance": "consortium",
    "budget guidance": "budget",
    "ethics guidance": "ethics",
    "dissemination guidance": "dissemination",
}
BLOCK_HEADINGS = (
    "Scope",
    "Objective",
    "Objectives",
    "Specific Conditions",
    "Type of action",
    "Eligibility",
    "Destination",
    "Cluster",
    "Expected Outcomes",
)
BULLET_SIGNS = ("-", "*", "•")
PORTAL_HOSTS = ("ec.europa.eu", "commission.europa.eu")
PORTAL_TOPIC_SHAPE = r"[A-Za-z0-9][A-Za-z0-9-]{6,}-[A-Za-z0-9-]+"

PROPOSAL_DEFAULTS = {
    "programme": "horizon_europe",
    "call_id": "UNSPECIFIED-CALL",
    "year": 2024,
    "outcome": "funded",
    "language": "en",
}

# --- fixed values: citation labels, notes and audit canaries ----------------------------------

PROMPT_STATUS_LABEL = {
    "funded": "FUNDED",
    "rejected": "REJECTED",
    "esr_note": "ESR NOTE",
    "unknown": "UNKNOWN",
}
STATUS_LABEL = {
    "funded": "FUNDED",
    "rejected": "REJECTED",
    "esr_note": "ESR NOTE",
    "unknown": "UNKNOWN STATUS",
}
STATUS_BADGE = {
    "funded": "✓ FUNDED",
    "rejected": "✗ REJECTED",
    "esr_note": "ⓘ ESR ADVISORY",
    "unknown": "? UNKNOWN",
}
STATUS_CAVEAT = {
    "funded": "",
    "rejected": "_Cautionary lesson — this proposal was NOT funded._",
    "esr_note": "_Reviewer commentary — advisory only, not ground truth._",
    "unknown": "_Source status unverified — treat with caution._",
}
NO_EVIDENCE_SENTENCE = (
    "No retrieved evidence was available; expand the index "
    "with relevant past proposals before relying on this draft."
)
PLACEHOLDER_PATTERN = r"This sentence references retrieved example \[\d+\] as supporting evidence"
SMOKE_TOLERATED_CODES = ("placeholder_text",)
REFERENCES_HEADING = "## References"
REFERENCES_TABLE_HEAD = (
    "| # | Status | Programme | Call | Section | Page | Source |\n"
    "|---|--------|-----------|------|---------|------|--------|"
)

# --- fixed values: iteration history ----------------------------------------------------------

MAX_ITERATIONS = 5
MAX_CRITIQUE_CHARS = 4000
DEFAULT_REQUIREMENT = "default-section-guidance"
EMPTY_CRITIQUE = (
    "(no critique produced — the LLM returned an empty response; "
    "review the prior draft manually)"
)
CHANGE_NONE = (
    "No structural change — text length and citation count are identical "
    "to the prior draft. Review the critique for substantive feedback."
)
CHANGE_GROWN = "Draft expanded — added detail in response to the critique."
CHANGE_SHRUNK = "Draft tightened — removed or condensed content per the critique."

# --- fixed values: snippets -------------------------------------------------------------------

PROMPT_SNIPPET_CHARS = 300
LISTING_SNIPPET_CHARS = 200

#: Digits of a score in results; ranking and thresholds see more.
SCORE_DIGITS = 6
