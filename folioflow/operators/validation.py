"""Constraint checks as jobs: valid rows, and rejects with every reason they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import is_blank, strip

HASH_SHAPE = r"\A[0-9a-f]{64}\z"


def reasons(**broken: Column) -> Column:
    """Array of the names whose condition holds (null counts as not broken)."""
    flags = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in broken.items()]
    return F.filter(F.array(*flags), lambda r: r.isNotNull())


def proposal_errors() -> Column:
    c = F.col
    return reasons(
        programme=~F.coalesce(c("programme").isin(*vocab.PROGRAMMES), F.lit(False)),
        call_id=is_blank(c("call_id")),
        year=~F.coalesce(c("year").between(2014, 2099), F.lit(False)),
        outcome=~F.coalesce(c("outcome").isin(*vocab.SOURCE_STATUSES), F.lit(False)),
        source_path=is_blank(c("source_path")),
        content_hash=c("content_hash").isNotNull() & ~c("content_hash").rlike(HASH_SHAPE),
    )


def clean_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with ``reasons`` (empty when valid); identifiers are stored trimmed."""
    return (
        proposals.withColumn("reasons", proposal_errors())
        .withColumn("call_id", strip(F.col("call_id")))
        .withColumn("source_path", strip(F.col("source_path")))
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a table with a ``reasons`` array."""
    bad = F.size("reasons") > 0
    return checked.filter(~bad).drop("reasons"), checked.filter(bad)


def chunk_errors(outcome: Column | None = None) -> Column:
    """Anchor and label checks of a chunk row; ``outcome`` adds the status-drift check."""
    c = F.col
    checks = dict(
        section_type=~F.coalesce(c("section_type").isin(*vocab.SECTION_TYPES), F.lit(False)),
        source_status=~F.coalesce(c("source_status").isin(*vocab.SOURCE_STATUSES), F.lit(False)),
        chunk_index=c("chunk_index") < 0,
        page=c("page") < 1,
        char_start=c("char_start") < 0,
        char_end=(c("char_end") < 0) | (c("char_end") < c("char_start")),
    )
    if outcome is not None:
        checks["status_drift"] = ~c("source_status").eqNullSafe(outcome)
    return reasons(**checks)


def request_errors(
    most: int, programme: str = "programme", section: str = "section_type", status: str = "source_status"
) -> Column:
    """Bounds and memberships of a search (most 100) or drafting (most 20) request."""
    c = F.col
    return reasons(
        query=is_blank(c("query")),
        top_k=(c("top_k") < 1) | (c("top_k") > most) | c("top_k").isNull(),
        programme=~c(programme).isin(*vocab.PROGRAMMES),
        section_type=~c(section).isin(*vocab.SECTION_TYPES),
        source_status=~c(status).isin(*vocab.SOURCE_STATUSES),
    )


def result_count_mismatches(responses: DataFrame, results: DataFrame) -> DataFrame:
    """Queries whose declared ``result_count`` differs from their number of results."""
    counted = results.groupBy("query_id").agg(F.count("*").alias("actual"))
    actual = F.coalesce("actual", F.lit(0))
    return (
        responses.join(counted, "query_id", "left")
        .filter(F.col("result_count") != actual)
        .select("query_id", "result_count", actual.alias("actual"))
    )


# --- usage events ----------------------------------------------------------------------------

# fixed values: the closed field set of every event type, with Spark types; "?" may be null
EVENT_FIELDS = {
    "draft_started": {
        "section_type": "string",
        "target_programme": "string?",
        "top_k_examples": "int",
        "lessons_learned": "boolean",
        "model": "string",
        "drafting_profile": "string?",
        "topic_context_present": "boolean",
    },
    "draft_completed": {
        "section_type": "string",
        "generation_time_ms": "int",
        "citation_count": "int",
        "source_status_mix": "map<string,int>?",
        "model": "string",
        "drafting_profile": "string?",
        "iteration_count": "int?",
    },
    "export": {"kind": "string", "byte_count": "int", "section_type": "string?"},
    "feedback": {
        "feedback_type": "string",
        "accepted": "boolean",
        "section_type": "string?",
        "iteration_index": "int?",
    },
}
EVENT_COMMON = ("event_type", "timestamp")
# fixed values: fields that may be absent, since they have a default, but not null
EVENT_DEFAULTED = ("source_status_mix", "iteration_count")

# fixed values: lowest and highest number allowed
EVENT_RANGES = {
    "top_k_examples": (1, 20),
    "generation_time_ms": (0, None),
    "citation_count": (0, None),
    "iteration_count": (1, None),
    "byte_count": (0, None),
    "iteration_index": (0, None),
}
EVENT_NON_EMPTY = ("model", "kind", "feedback_type")


def _event_columns() -> dict[str, str]:
    out = {"event_type": "string", "timestamp": "timestamp"}
    for fields in EVENT_FIELDS.values():
        for name, kind in fields.items():
            out.setdefault(name, kind.rstrip("?"))
    return out


EVENT_SCHEMA = ", ".join(f"{n} {t}" for n, t in _event_columns().items())


def check_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to typed events with ``reasons``.

    The schema is closed per event type: an undeclared key, whatever it holds, refuses the
    line, and so do a missing required field, a wrong type or a number out of range.
    """
    raw = F.from_json(F.col(column), "map<string,string>")
    typed = F.from_json(F.col(column), EVENT_SCHEMA)
    parsed = lines.withColumns({"raw": raw, "event": typed})
    kind = F.coalesce(F.col("raw")["event_type"], F.lit(""))

    def spoils(field: str) -> Column:
        given = F.col("raw")[field].isNotNull()
        if field in EVENT_DEFAULTED:
            given = F.coalesce(F.array_contains(F.map_keys("raw"), field), F.lit(False))
        return given & F.col(f"event.{field}").isNull()

    allowed = missing = wrong = None
    for name, fields in EVENT_FIELDS.items():
        names = F.array(*[F.lit(f) for f in (*EVENT_COMMON, *fields)])
        required = [f for f, t in fields.items() if not t.endswith("?")]
        lacks = F.filter(
            F.array(*[F.when(F.col("raw")[f].isNull(), F.lit(f)) for f in required]),
            lambda x: x.isNotNull(),
        )
        spoiled = F.filter(
            F.array(
                *[
                    F.when(spoils(f), F.lit(f))
                    for f in ("timestamp", *fields)
                ]
            ),
            lambda x: x.isNotNull(),
        )
        hit = kind == name
        allowed = F.when(hit, names) if allowed is None else allowed.when(hit, names)
        missing = F.when(hit, lacks) if missing is None else missing.when(hit, lacks)
        wrong = F.when(hit, spoiled) if wrong is None else wrong.when(hit, spoiled)

    out_of_range = []
    for name, (low, high) in EVENT_RANGES.items():
        value = F.col(f"event.{name}")
        bad = value < low if high is None else ~value.between(low, high)
        out_of_range.append(F.when(bad, F.lit(name)))
    for name in EVENT_NON_EMPTY:
        out_of_range.append(F.when(F.col(f"event.{name}") == "", F.lit(name)))

    def tag(label: str, names: Column) -> Column:
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.concat(F.lit(f"{label}:"), n),
        )

    keys = F.map_keys("raw")
    known = kind.isin(*EVENT_FIELDS)
    problems = F.concat(
        F.when(F.col("raw").isNull(), F.array(F.lit("not_json"))).otherwise(
            F.array().cast("array<string>")
        ),
        F.when(F.col("raw").isNotNull() & ~known, F.array(F.lit("event_type"))).otherwise(
            F.array().cast("array<string>")
        ),
        tag("extra", F.sort_array(F.array_except(keys, allowed))),
        tag("missing", missing),
        tag("type", wrong),
        F.when(
            known, tag("range", F.filter(F.array(*out_of_range), lambda x: x.isNotNull()))
        ).otherwise(F.array().cast("array<string>")),
    )
    return parsed.select(
        *lines.columns, F.col("event"), problems.alias("reasons")
    )


