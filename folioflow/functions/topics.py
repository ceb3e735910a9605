"""Column functions that read call and topic fields out of free text and file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import (
    WHITESPACE,
    WS,
    collapse_whitespace,
    empty_to_null,
    is_blank,
    let,
    lookup,
    normalise_text,
    strip,
)

_EDGE_BEFORE = "(?<![A-Za-z0-9])"
_EDGE_AFTER = "(?![A-Za-z0-9])"
_STOP_TAIL = r"(?i)(?:-(?:%s))+\z" % "|".join(vocab.CALL_ID_STOP_TOKENS)
# what a line of a call text can begin with; everything else is body
_HEADINGS = (*(h.lower() for h in vocab.BLOCK_HEADINGS), *vocab.GUIDANCE_HEADINGS)
_LABELS = ("topic title", "topic", "destination", "cluster")
_KNOWN = tuple(dict.fromkeys((*_HEADINGS, *_LABELS)))
_LINE_END = "[\\n\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_PARAGRAPH_BREAK = rf"(?U)\n{WS}*\n"


def _call_run(text: Column) -> Column:
    """Run of letters, digits and dashes that starts with the first programme token."""
    return F.regexp_extract(
        text,
        rf"(?i){_EDGE_BEFORE}(?=(?:{vocab.PROGRAMME_TOKEN}){_EDGE_AFTER})[\p{{L}}\p{{N}}_-]+",
        0,
    )


def _programme_of_run(run: Column) -> Column:
    token = F.regexp_extract(run, rf"(?i)\A(?:{vocab.PROGRAMME_TOKEN}){_EDGE_AFTER}", 0)
    return lookup(F.upper(token), vocab.PROGRAMME_ALIASES)


def _call_id_of_run(run: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_extract(run, r"\A[^_]*", 0), _STOP_TAIL, "")
    return F.when(_programme_of_run(run).isNotNull() & cleaned.contains("-"), cleaned)


def programme_of(text: Column) -> Column:
    return let(_call_run(text), _programme_of_run)


def call_id_of(text: Column) -> Column:
    """The run from the programme token up to the first other character, junk tail removed;
    only a dashed run after a known programme is a call id."""
    return let(_call_run(text), _call_id_of_run)


def _topic_digits(text: Column) -> Column:
    return F.regexp_extract(text, r"(?<!\d)\d{6,7}(?!\d)", 0)


def topic_id_of(text: Column) -> Column:
    return let(_topic_digits(text), empty_to_null)


def classified(text: Column) -> Column:
    """Struct of a text's ``lines`` and the ``marks`` among them.

    A mark is a line whose part before the first colon is a known heading or label: its line number
    ``at``, that part in lower case as ``name``, and ``rest``, what follows the colon (null without
    one). All finds are made on the marks, so a text is read once.
    """

    def mark(line: Column, at: Column) -> Column:
        cut = F.instr(line, ":")
        before = F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line)
        return F.struct(
            at.alias("at"),
            F.lower(F.btrim(before, F.lit(" \t"))).alias("name"),
            F.when(cut > 0, F.substring(line, cut + 1, F.length(line))).alias("rest"),
        )

    def over(lines: Column) -> Column:
        known = F.filter(F.transform(lines, mark), lambda m: m["name"].isin(*_KNOWN))
        return F.struct(lines.alias("lines"), known.alias("marks"))

    return let(F.split(text, "\n"), over)


def _first(marks: Column, wanted: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(marks, wanted), F.lit(0))


def _label_value(parts: Column, label: str) -> Column:
    """Text after the first ``Label:`` line that has any; null if none has."""
    return strip(_first(parts["marks"], lambda m: (m["name"] == label.lower()) & (F.length(m["rest"]) > 0))["rest"])


def _block(parts: Column, heading: str) -> Column:
    """Lines between a bare heading line and the next line that begins with a heading."""

    def between(start: Column) -> Column:
        after = _first(parts["marks"], lambda m: (m["at"] > start["at"]) & m["name"].isin(*_HEADINGS))
        stop = F.coalesce(after["at"], F.size(parts["lines"]))
        body = F.slice(parts["lines"], start["at"] + 2, stop - start["at"] - 1)
        return F.when(start.isNotNull(), strip(F.array_join(body, "\n")))

    bare = _first(
        parts["marks"],
        lambda m: (m["name"] == heading.lower())
        & F.coalesce(F.btrim(m["rest"], F.lit(" \t")) == "", F.lit(True)),
    )
    return let(bare, between)


def labelled_line(text: Column, *labels: str) -> Column:
    """Value after ``Label:`` on one line; labels are tried in the given order."""
    return let(
        classified(text),
        lambda parts: F.coalesce(*[empty_to_null(_label_value(parts, label)) for label in labels]),
    )


def block_after(text: Column, heading: str) -> Column:
    """Text below a heading line, up to the next known heading line or the end."""
    return let(classified(text), lambda parts: empty_to_null(_block(parts, heading)))


def _without_bullet(line: Column) -> Column:
    """What follows a bullet (a sign, or digits and a dot, then white space); null for other lines."""
    body = F.ltrim(line, F.lit(" \t"))
    digits = F.length(body) - F.length(F.ltrim(body, F.lit("0123456789")))
    numbered = (digits > 0) & (F.substring(body, digits + 1, F.lit(1)) == ".")
    after = (
        F.when(F.left(body, F.lit(1)).isin(*vocab.BULLET_SIGNS), F.substring(body, F.lit(2), F.length(body)))
        .when(numbered, F.substring(body, digits + 2, F.length(body)))
    )
    trimmed = F.ltrim(after, F.lit(WHITESPACE))
    return F.when(F.length(trimmed) < F.length(after), trimmed)


def split_bullets(block: Column) -> Column:
    """Bullets of a block; lines that follow a bullet belong to it.

    Without any bullet every paragraph is one entry.
    """

    def group(kinds: Column) -> Column:
        """One entry per bullet: an accumulator of finished entries, a line at a time."""
        none = F.array().cast("array<string>")

        def add(done: Column, line: Column) -> Column:
            last = F.element_at(done, -1)
            longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", last, line["body"])))
            return (
                F.when(line["bullet"], F.concat(done, F.array(line["body"])))
                .when((F.size(done) == 0) | (line["body"] == ""), done)
                .otherwise(longer)
            )

        entries = F.aggregate(kinds, none, add)
        return F.filter(F.transform(entries, strip), lambda e: e != "")

    def kind(line: Column) -> Column:
        return let(
            _without_bullet(line),
            lambda rest: F.struct(rest.isNotNull().alias("bullet"), strip(F.coalesce(rest, line)).alias("body")),
        )

    def entries(kinds: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(block, _PARAGRAPH_BREAK), strip), lambda p: p != "")
        return F.when(F.exists(kinds, lambda k: k["bullet"]), group(kinds)).otherwise(paragraphs)

    found = let(F.transform(F.split(block, _LINE_END), kind), entries)
    return F.when(is_blank(block), F.array().cast("array<string>")).otherwise(found)


def collapse_paragraphs(block: Column) -> Column:
    """White space collapsed inside each paragraph, paragraph breaks kept."""
    kept = F.filter(
        F.transform(F.split(block, _PARAGRAPH_BREAK), collapse_whitespace), lambda p: p != ""
    )
    return let(F.array_join(kept, "\n\n"), empty_to_null)


def _guidance(parts: Column) -> Column:
    pairs: list[Column] = []
    for heading, section in vocab.GUIDANCE_HEADINGS.items():
        pairs += [F.lit(section), _block(parts, heading)]
    return F.map_filter(F.create_map(*pairs), lambda _k, v: F.coalesce(v != "", F.lit(False)))


def section_guidance(text: Column) -> Column:
    """Map of section type to its guidance block, for the headings that are present."""
    return let(classified(text), _guidance)


def topic_context(text: Column, source_path: Column | None = None) -> Column:
    """Struct of every field that can be read out of a call text.

    The lines are classified once; every field is found on the few marked ones.
    """
    path = F.lit(None).cast("string") if source_path is None else source_path

    def finds(t: Column) -> Column:
        return let(
            F.struct(t.alias("text"), classified(t).alias("parts")),
            lambda x: F.struct(
                x["text"].alias("text"),
                _call_run(x["text"]).alias("run"),
                _topic_digits(x["text"]).alias("topic"),
                _label_value(x["parts"], "topic title").alias("title"),
                _label_value(x["parts"], "topic").alias("short_title"),
                _label_value(x["parts"], "destination").alias("destination"),
                _label_value(x["parts"], "cluster").alias("cluster"),
                F.coalesce(_block(x["parts"], "expected outcomes"), F.lit("")).alias("outcomes"),
                F.coalesce(_block(x["parts"], "scope"), F.lit("")).alias("scope"),
                _guidance(x["parts"]).alias("guidance"),
            ),
        )

    def fields(f: Column) -> Column:
        title = F.coalesce(empty_to_null(f["title"]), empty_to_null(f["short_title"]))
        return F.struct(
            _programme_of_run(f["run"]).alias("programme"),
            _call_id_of_run(f["run"]).alias("call_id"),
            empty_to_null(f["topic"]).alias("topic_id"),
            F.when(~title.rlike(r"\A\d{6,7}\z"), title).alias("topic_title"),
            split_bullets(f["outcomes"]).alias("expected_outcomes"),
            collapse_paragraphs(f["scope"]).alias("scope"),
            F.coalesce(empty_to_null(f["destination"]), empty_to_null(f["cluster"])).alias(
                "destination"
            ),
            f["guidance"].alias("section_guidance"),
            f["text"].alias("raw_text"),
            F.when(path.isNull(), F.lit("pasted_text")).otherwise("pdf_excerpt").alias("source"),
            path.alias("source_path"),
        )

    return let(let(normalise_text(text), finds), fields)


def topic_is_empty(context: Column) -> Column:
    return (
        F.coalesce(context.topic_id, F.lit("")).eqNullSafe("")
        & F.coalesce(context.topic_title, F.lit("")).eqNullSafe("")
        & (F.size(context.expected_outcomes) == 0)
    )


def flatten_parsed(title: Column, sections: Column) -> Column:
    """Title and every ``heading``/``text`` pair as one text, blank lines between."""
    body = F.transform(sections, lambda s: F.concat(s["heading"], F.lit("\n"), s["text"]))
    head = F.filter(F.array(empty_to_null(title)), lambda x: x.isNotNull())
    return F.array_join(F.concat(head, body), "\n\n")


def metadata_suggestion(file_name: Column, title: Column) -> Column:
    """Draft metadata from an uploaded file's own name and its parsed title."""

    def fields(t: Column) -> Column:
        return F.struct(
            programme_of(t).alias("programme"),
            call_id_of(t).alias("call_id"),
            topic_id_of(t).alias("topic_id"),
            empty_to_null(title).alias("proposal_title"),
        )

    seed = F.concat_ws("\n", file_name, empty_to_null(title))
    return let(normalise_text(seed), fields)


def filename_metadata(file_name: Column) -> Column:
    """Programme, call and topic encoded in a file name (extension ignored)."""
    stem = F.regexp_replace(file_name, r"(?s)\A(.*)\.[^.]*\z", "$1")

    def fields(s: Column) -> Column:
        return F.struct(
            programme_of(s).alias("programme"),
            call_id_of(s).alias("call_id"),
            topic_id_of(s).alias("topic_id"),
        )

    return let(stem, fields)


def synthesised_metadata(path: Column, overrides: dict[str, Column] | None = None) -> Column:
    """Full metadata for a file without a sidecar.

    Precedence, weakest first: defaults, file name, overrides, values derived from the path.
    """
    from folioflow.functions.ids import document_id

    overrides = overrides or {}
    name = F.regexp_extract(path, r"([^/]+)/*\z", 1)

    def pick(field: str, parsed: Column | None, kind: str) -> Column:
        options = [overrides[field].cast(kind)] if field in overrides else []
        if parsed is not None:
            options.append(parsed.cast(kind))
        if field in vocab.PROPOSAL_DEFAULTS:
            options.append(F.lit(vocab.PROPOSAL_DEFAULTS[field]).cast(kind))
        return F.coalesce(*options).alias(field)

    def fields(m: Column) -> Column:
        return F.struct(
            pick("programme", m.programme, "string"),
            pick("call_id", m.call_id, "string"),
            pick("topic_id", m.topic_id, "string"),
            pick("year", None, "int"),
            pick("outcome", None, "string"),
            pick("language", None, "string"),
            document_id(path).alias("proposal_title"),
            path.alias("source_path"),
        )

    return let(filename_metadata(name), fields)
