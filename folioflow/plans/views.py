"""Typed views the registered queries run on, derived from the given tables.

Each view covers its whole base table: flaws, variants and metadata are assigned to every
row by arithmetic on its key, never by picking a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.ids import content_hash
from folioflow.functions.text import iso_utc, let, lookup
from folioflow.operators.chunking import chunk_documents
from folioflow.operators.embedding import hash_embedding
from folioflow.operators.latency import exact_percentile
from folioflow.operators.structure import attach_tables, tables_of

LINES_PER_SECTION = 4

HEADINGS = (
    "1. Excellence",
    "2.1 Impact pathway",
    "Methodology",
    "Work plan and deliverables",
    "Implementation",
    "Consortium and partners",
    "Budget and resources",
    "Ethics",
    "Dissemination and exploitation",
    "Expected impact",
    "Annex A",
    "Summary",
)
HEADINGS_ES = 4  # Spanish documents use the first four headings only

PROGRAMME_BY_LANG = {
    "en": "horizon_europe",
    "fr": "horizon_2020",
    "de": "digital_europe",
    "es": "cef",
}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table.

    ``spread`` is for work that is heavy per row: a table that comes in fewer splits than
    there are cores (one small file) is dealt out evenly. A table of cluster size has more
    splits than that and is left as it is, so nothing is shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def doc_key(doc_id: Column) -> Column:
    return F.concat(F.lit("doc_"), doc_id.cast("string"))


def element(values: tuple, index: Column) -> Column:
    """Element of a fixed list, 0-based."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def heading_of(doc_id: Column, lang: Column, pos: Column) -> Column:
    span = F.when(lang == "es", HEADINGS_ES).otherwise(len(HEADINGS))
    return element(HEADINGS, (doc_id + pos) % span)


def outcome_of(quality: Column, toxic: Column) -> Column:
    return (
        F.when(quality.isNull(), "unknown")
        .when(quality == 0, "rejected")
        .when(toxic == 1, "esr_note")
        .otherwise("funded")
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def text_keys() -> list[Column]:
    """What proposal metadata needs of a text; taken before any join, so that no text is shuffled."""
    return [
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"),
        content_hash(F.col("text")).alias("content_hash"),
    ]


def proposal_columns() -> list[Column]:
    """Proposal metadata of a labelled document row that has its text_keys()."""
    doc = F.col("doc_id")
    return [
        doc_key(doc).alias("document_id"),
        lookup(F.col("lang"), PROGRAMME_BY_LANG, F.lit("other")).alias("programme"),
        F.concat(F.lit("CALL-"), F.upper("source")).alias("call_id"),
        F.when(doc % 3 == 0, (900000 + doc % 100000).cast("string")).alias("topic_id"),
        (2014 + doc % 12).cast("int").alias("year"),
        outcome_of(F.col("quality"), F.col("toxic")).alias("outcome"),
        F.col("first_line").alias("proposal_title"),
        F.when(doc % 5 == 0, F.concat(F.lit("ACR-"), (doc % 97).cast("string"))).alias("consortium_acronym"),
        F.concat(F.lit("corpus/"), "source", F.lit("/"), doc_key(doc), F.lit(".pdf")).alias(
            "source_path"
        ),
        F.col("lang").alias("language"),
        F.when(doc % 7 != 3, F.timestamp_seconds(1_700_000_000 + doc * 60)).alias("ingested_at"),
        F.col("content_hash"),
    ]


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", *text_keys())
    return keyed.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", *proposal_columns())


def raw_tables_of(doc_id: Column, text: Column) -> Column:
    """One sparse table per document: a row per line, phrase j of a line written to column
    j mod 5 of a four-column grid. Odd documents declare one row too few."""
    lines = F.split(text, "\n")
    cells = F.flatten(
        F.transform(
            lines,
            lambda line, i: F.transform(
                F.split(line, ", "),
                lambda w, j: F.struct(
                    i.alias("row"), (j % 5).alias("col"), w.alias("text")
                ),
            ),
        )
    )
    page = F.when(doc_id % 9 != 0, (1 + doc_id % 4).cast("int"))
    return F.array(
        F.struct(
            (F.size(lines) - (doc_id % 2)).cast("int").alias("num_rows"),
            F.lit(4).alias("num_cols"),
            F.array(F.lit(0), page).alias("prov"),
            cells.alias("cells"),
        )
    )


def section_count(lines: Column) -> Column:
    return (F.floor((F.size(lines) - 1) / LINES_PER_SECTION) + 1).cast("int")


def plain_sections(doc_id: Column, lang: Column, text: Column) -> Column:
    """Four lines per section; odd documents separate lines by a blank line."""
    gap = F.when(doc_id % 2 == 1, "\n\n").otherwise("\n")

    def cut(lines: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), section_count(lines) - 1),
            lambda p: F.struct(
                heading_of(doc_id, lang, p).alias("heading"),
                F.lit(1).alias("level"),
                F.call_function(
                    "array_join",
                    F.slice(lines, p * LINES_PER_SECTION + 1, F.lit(LINES_PER_SECTION)),
                    gap,
                ).alias("text"),
                (p + 1).alias("page_start"),
                (p + 1).alias("page_end"),
            ),
        )

    return let(F.split(text, "\n"), cut)


def parsed_sections() -> Column:
    """Sections, with their tables, of a document row."""
    doc, text = F.col("doc_id"), F.col("text")
    return attach_tables(
        plain_sections(doc, F.col("lang"), text), tables_of(raw_tables_of(doc, text))
    )


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True).select(
        doc_key(F.col("doc_id")).alias("document_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        parsed_sections().alias("sections"),
    )


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout items with every irregularity the section builder has to handle."""
    d = table(spark, sf_dir, "documents", spread=True)
    doc = F.col("doc_id")

    def item(kind: str, depth: Column, text: Column, level: Column, prov: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            depth.cast("int").alias("depth"),
            text.alias("text"),
            level.cast("int").alias("level"),
            prov.cast("array<int>").alias("prov"),
        )

    one = F.lit(1)
    nothing = F.array().cast("array<int>")

    def header(p: Column) -> Column:
        blank = (doc + p) % 7 == 0
        heading = F.concat(F.lit(" "), heading_of(doc, F.col("lang"), p))
        prov = F.when(p % 4 == 3, nothing).otherwise(F.array(F.lit(0), p + 1))
        return item("section_header", one, F.when(blank, "  ").otherwise(heading), (doc + p) % 9, prov)

    def body(lines: Column, p: Column) -> Column:
        return F.transform(
            F.slice(lines, p * LINES_PER_SECTION + 1, F.lit(LINES_PER_SECTION)),
            lambda x, j: item(
                "text",
                F.when((p * LINES_PER_SECTION + j) % 11 == 5, 2).otherwise(1),
                F.concat(F.lit(" "), x),
                F.lit(None),
                F.array((p + 1 + F.floor(j / 2)).cast("int")),
            ),
        )

    items = let(
        F.split("text", "\n"),
        lambda lines: F.flatten(
            F.transform(
                F.sequence(F.lit(0), section_count(lines) - 1),
                lambda p: F.concat(F.array(header(p)), body(lines, p)),
            )
        ),
    )
    title = F.when(
        doc % 4 == 0,
        F.array(item("title", one, F.concat(F.lit(" Title of "), doc_key(doc)), F.lit(None), nothing)),
    ).otherwise(F.array().cast(_ITEMS))
    cover = F.when(
        doc % 5 == 0, F.array(item("text", one, F.lit("cover page"), F.lit(None), F.array(one)))
    ).otherwise(F.array().cast(_ITEMS))
    return d.select(
        doc_key(doc).alias("document_id"),
        F.concat(F.lit("name_"), doc.cast("string")).alias("name"),
        F.concat(title, cover, items).alias("items"),
        raw_tables_of(doc, F.col("text")).alias("raw_tables"),
    )


_ITEMS = "array<struct<kind: string, depth: int, text: string, level: int, prov: array<int>>>"


def chunks(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """The chunk table. Text and metadata come from the same document row here, so one scan
    feeds both; separately stored ones meet in ``chunking.with_proposals``. ``among``, a small
    table of document ids, leaves other documents out before they are cut into chunks."""
    rows = labelled_documents(spark, sf_dir)
    if among is not None:
        rows = rows.join(among.toDF("wanted"), doc_key(F.col("doc_id")).eqNullSafe(F.col("wanted")), "left_semi")
    rows = rows.withColumns({"first_line": text_keys()[0], "content_hash": text_keys()[1]}).select(
        *proposal_columns(), parsed_sections().alias("sections")
    )
    return chunk_documents(
        rows.withColumnRenamed("outcome", "source_status")
    )


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("embedding", hash_embedding(F.col("text")))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per benchmark text, with filters and overrides by arithmetic."""
    q = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        q.alias("query_id"),
        F.col("text").alias("query"),
        (3 + q % 5).cast("int").alias("top_k"),
        F.when(q % 4 != 0, element(vocab.PROGRAMMES, q % 5)).alias("programme"),
        F.when(q % 3 != 0, element(vocab.SECTION_TYPES, q % 11)).alias("section_type"),
        F.when(q % 10 == 9, element(vocab.SOURCE_STATUSES, F.floor(q / 10) % 4)).alias(
            "source_status"
        ),
        F.when(q % 4 == 1, F.lit(True)).when(q % 4 == 2, F.lit(False)).alias("lessons_learned"),
        F.when(q % 7 == 5, F.lit(False)).alias("section_type_fallback"),
    )


# --- calls, file names, portal links -----------------------------------------------------------

CALL_NAMES = (
    "HORIZON-CL4-2024-DATA-01-02",
    "H2020-SU-ICT-2019-FINAL",
    "HE-Widera-Part",
    "HORIZON_EUROPE",
    "horizon-cl7-2023-annex-draft",
    "HORIZON_CL3-2021",
    "DIGITAL-2022-AI",
    "XH2020-glued",
)
BULLETS = ("- ", "* ", "1. ")


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call excerpt per document, its prose taken from the whole document text."""
    d = table(spark, sf_dir, "documents", spread=True)
    doc = F.col("doc_id")
    lines = F.split("text", "\n")
    bullet = element(BULLETS, doc % 3)
    marked = F.transform(lines, lambda x, i: F.when(i % 2 == 0, F.concat(bullet, x)).otherwise(x))
    outcomes = F.when(doc % 4 == 3, F.array_join(lines, "\n\n")).otherwise(
        F.array_join(marked, "\n")
    )
    eol = F.when(doc % 5 == 0, "\r\n").otherwise("\n")
    raw = F.concat(
        F.when(doc % 6 == 0, "\ufeff").otherwise(""),
        F.lit("Programme: Research\nCall: "), element(CALL_NAMES, doc % 8),
        F.lit("\nTopic: "), (950000 + doc).cast("string"),
        F.when(doc % 3 != 1, F.concat(F.lit("\n  topic title : Title "), F.col("source"))).otherwise(""),
        F.lit("\nDestination: Area "), F.col("lang"),
        F.lit("\n\n\n\nExpected Outcomes:\n"), outcomes,
        F.when(doc % 7 != 2, F.concat(F.lit("\nScope\n"), F.array_join(lines, "\n \n"))).otherwise(""),
        F.lit("\nMethodology guidance:\nUse sound   methods.\n"),
        F.when(doc % 2 == 0, "Impact guidance\n\nShow impact.\n").otherwise(""),
        F.lit("Type of action: RIA\n"),
    )
    return d.select("doc_id", F.replace(raw, F.lit("\n"), eol).alias("text"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    doc = F.col("doc_id")
    name = F.concat(
        F.when(doc % 3 == 0, "proposal_").otherwise(""),
        element(CALL_NAMES, doc % 8),
        F.when(doc % 5 < 2, F.concat(F.lit("_"), (880000 + doc).cast("string"))).otherwise(""),
        F.when(doc % 4 == 1, "-PartB").when(doc % 4 == 2, "-SEALED-Final").otherwise(""),
        F.when(doc % 7 == 0, "").when(doc % 7 == 1, ".PDF").otherwise(".pdf"),
    )
    return d.select("doc_id", "source", "lang", name.alias("file_name"))


def portal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal links in every accepted and refused form, each with a stored search payload."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    page = F.col("page_id")
    topic = F.format_string("HORIZON-CL%d-2026-%06d-A", page % 9, page)
    base = F.lit("https://ec.europa.eu/info/portal/screen/topic-details/")
    url = (
        F.when(page % 8 == 0, F.concat(base, topic, F.lit("?keywords=/topic-details/none")))
        .when(page % 8 == 1, F.concat(base, topic, F.lit("/")))
        .when(page % 8 == 2, F.concat(base, topic, F.lit(".json#top")))
        .when(page % 8 == 3, F.concat(F.lit(" HTTP://user@Commission.Europa.EU:443/topic-details/"), topic, F.lit(";v=1 ")))
        .when(page % 8 == 4, F.col("url"))
        .when(page % 8 == 5, F.concat(F.lit("https://ec.europa.eu/list?topic="), topic))
        .when(page % 8 == 6, F.concat(base, F.lit("short")))
        .otherwise(F.concat(F.lit("ftp://ec.europa.eu/topic-details/"), topic))
    )
    other = F.concat(topic, F.lit("-X"))
    first = F.when(page % 3 == 0, other).otherwise(topic)
    second = F.when(page % 5 == 0, other).otherwise(topic)
    title = F.when(page % 7 == 0, '""').otherwise(
        F.concat(F.lit('["Topic page '), page.cast("string"), F.lit('", "second"]'))
    )

    def result(ident: Column) -> Column:
        return F.concat(
            F.lit('{"metadata": {"identifier": ["'), ident,
            F.lit('"], "callIdentifier": "CALL-'), ident,
            F.lit('", "title": '), title, F.lit(', "callTitle": ["Call of '), ident, F.lit('"]}}'),
        )

    payload = F.concat(F.lit('{"results": ['), result(first), F.lit(", "), result(second), F.lit("]}"))
    return p.select(
        "page_id", url.alias("url"), F.when(page % 11 != 0, payload).alias("payload")
    )


# --- duplicates -----------------------------------------------------------------------------------


FRESH_HASHES = (0, 0, 1, 2, 3, 3)
FRESH_IDS = (0, 1, 1, 2, 1, 3)
FRESH_TITLES = (0, 1, 2, 2, 3, 0)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document presented again: same bytes under a new id, new bytes under the same
    id, same title and call under a new id, or a new proposal that meets others in the batch."""
    p = proposals(spark, sf_dir)
    doc = F.col("doc_id")
    kind = doc % 4
    k = F.floor(doc / 4).cast("bigint")

    def by_kind(copy: Column, same: Column, alt: Column, new: Column) -> Column:
        return F.when(kind == 0, copy).when(kind == 1, same).when(kind == 2, alt).otherwise(new)

    ident = F.col("document_id")
    revised = content_hash(F.concat("content_hash", F.lit(" revised")))
    block = (F.floor(k / 6) * 10).cast("bigint")

    def shared(slots: tuple) -> Column:
        """Key of a new proposal: equal slots of a block of six share one key."""
        return (block + element(slots, k % 6)).cast("string")

    fresh = content_hash(F.concat(F.lit("fresh "), shared(FRESH_HASHES)))
    return p.select(
        doc.alias("position"),
        by_kind(
            F.concat(F.lit("copy_"), ident),
            ident,
            F.concat(F.lit("alt_"), ident),
            F.concat(F.lit("new_"), shared(FRESH_IDS)),
        ).alias("document_id"),
        by_kind(
            F.col("content_hash"), revised, F.when(doc % 16 != 2, revised), fresh
        ).alias("content_hash"),
        by_kind(
            F.col("proposal_title"),
            F.col("proposal_title"),
            F.when(doc % 12 != 6, F.col("proposal_title")).otherwise("  "),
            F.concat(F.lit("Fresh proposal "), shared(FRESH_TITLES)),
        ).alias("proposal_title"),
        by_kind(F.col("call_id"), F.col("call_id"), F.col("call_id"), F.lit("CALL-NEW")).alias(
            "call_id"
        ),
    )


# --- drafts ----------------------------------------------------------------------------------------


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a draft version with citations, some of them flawed."""
    turns = table(spark, sf_dir, "conversations", spread=True).filter(F.col("role") == "assistant")
    conv, turn = F.col("conv_id"), F.col("turn")
    n = ((conv + turn) % 6).cast("int")
    flaw = conv % 12

    def citation(i: Column) -> Column:
        key = conv + i
        return F.struct(
            F.when((flaw == 1) & (i == 2), 1).when((flaw == 2) & (i == 2), 9).otherwise(i).cast("int").alias("citation_id"),
            F.when((flaw == 3) & (i == 1), F.lit(None)).otherwise(element(vocab.SOURCE_STATUSES, key % 4)).alias("source_status"),
            F.when((flaw == 4) & (i == 1), F.lit(" ")).otherwise(element(vocab.PROGRAMMES, key % 5)).alias("programme"),
            F.when((flaw == 5) & (i == 1), F.lit("")).otherwise(F.concat(F.lit("CALL|"), key.cast("string"))).alias("call_id"),
            F.when(key % 3 != 0, F.concat(F.lit("Proposal "), key.cast("string"))).alias("proposal_title"),
            F.when(key % 4 != 1, element(HEADINGS, key % 12)).alias("section_heading"),
            F.when(key % 5 != 2, (1 + key % 30).cast("int")).alias("page"),
            F.concat(doc_key(key), F.lit("::0")).alias("chunk_id"),
            F.when((flaw == 6) & (i == 1), F.lit("  ")).otherwise(F.concat(F.lit("Excerpt "), key.cast("string"))).alias("snippet"),
        )

    citations = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), citation)).otherwise(
        F.array().cast(_CITATIONS)
    )
    cited = F.when(
        n > 0,
        F.concat(
            F.lit(" Evidence"),
            F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(" ["), i.cast("string"), F.lit("]"))), ""),
        ),
    ).otherwise("")
    text = F.concat(
        F.col("text"),
        cited,
        F.when(flaw == 7, F.concat(F.lit(" See ["), (conv * 3 + turn).cast("string"), F.lit("] and [012] again [100]."))).otherwise(""),
        F.when(flaw == 8, "\n## References\nAs said [1].").otherwise(""),
        F.when(flaw == 9, F.concat(F.lit(" "), F.lit(vocab.NO_EVIDENCE_SENTENCE))).otherwise(""),
        F.when(flaw == 10, " This sentence references retrieved example [1] as supporting evidence.").otherwise(""),
        F.when(conv % 5 == 0, " \n").otherwise(""),
    )
    return turns.select(
        F.concat(F.lit("drafts/"), conv.cast("string"), F.lit("/"), turn.cast("string"), F.lit(".json")).alias("draft_path"),
        conv.alias("draft_id"),
        F.floor((turn + 1) / 2).cast("int").alias("iteration"),
        element(vocab.SECTION_TYPES, conv % 11).alias("section_type"),
        text.alias("text"),
        citations.alias("citations"),
        (conv * 7 % 900 + turn).cast("int").alias("elapsed_ms"),
        (1 + conv % 20).cast("int").alias("top_k"),
        F.when(conv % 6 == 0, "  ").otherwise(F.col("text")).alias("critique"),
    )


_CITATIONS = (
    "array<struct<citation_id: int, source_status: string, programme: string, call_id: string, "
    "proposal_title: string, section_heading: string, page: int, chunk_id: string, snippet: string>>"
)


# --- events -------------------------------------------------------------------------------------------


def sidecar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML sidecar per document: flat or nested, with comments and quotes, some of them unreadable."""
    p = proposals(spark, sf_dir)
    doc = F.col("doc_id")

    def quoted(c: Column) -> Column:
        """A double-quoted scalar; the escapes of JSON are escapes here, too."""
        return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{.x.:(.*)\}$", 1)

    def line(name: str, value: Column, indent: Column) -> Column:
        return F.concat(indent, F.lit(f"{name}: "), F.coalesce(value, F.lit("null")), F.lit("\n"))

    nested = doc % 3 == 1
    indent = F.when(nested, "  ").otherwise("")
    year = F.when(doc % 17 == 3, F.lit("[2020]")).otherwise(F.col("year").cast("string"))
    body = F.concat(
        line("programme", F.col("programme"), indent), line("call_id", quoted(F.col("call_id")), indent),
        line("topic_id", F.concat(F.lit("'"), "topic_id", F.lit("'  # within the call")), indent), line("year", year, indent),
        line("outcome", F.col("outcome"), indent), line("proposal_title", quoted(F.col("proposal_title")), indent),
        F.when(F.col("consortium_acronym").isNotNull(), line("consortium_acronym", F.col("consortium_acronym"), indent)).otherwise(""),
        line("source_path", F.col("source_path"), indent), line("language", F.col("language"), indent),
        line("ingested_at", iso_utc(F.col("ingested_at")), indent), line("content_hash", quoted(F.col("content_hash")), indent),
        F.when(doc % 17 == 9, F.concat(indent, F.lit("snippet: x\n"))).otherwise(""),
    )
    text = F.concat(F.lit("# sidecar\n---\n"), F.when(nested, "chunk_index: 0\nproposal:\n").otherwise(""), body)
    flawed = F.when(doc % 17 == 5, 'call_id: "open\nyear: [').when(doc % 17 == 7, "- programme\n- call_id\n").when(doc % 17 == 8, "")
    return p.select("doc_id", F.coalesce(flawed, text).alias("sidecar_text"))


def pilots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pilot per user with its mode and probe results."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    return e.select("user_id").distinct().select(
        user.alias("pilot_id"),
        F.when(user % 3 == 0, "smoke").otherwise("coordinator").alias("mode"),
        (user % 17 != 0).alias("smoke_passed"),
        (user % 13 != 0).alias("audit_passed"),
        (user % 6 == 0).alias("smoke_blocking"),
    )


def pilot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else a pilot's report shows: identity, notes, smoke detail, and measurements over its user's events."""
    pilot = F.col("pilot_id")
    ms = measurements(spark, sf_dir, F.col("user_id").alias("pilot_id")).select("pilot_id", "elapsed_ms")
    slow = exact_percentile(ms, ("pilot_id",), "elapsed_ms", 95)
    seen = ms.groupBy("pilot_id").agg(
        F.count("*").alias("n"), F.sum("elapsed_ms").alias("total"), F.avg("elapsed_ms").alias("mean"), F.max("elapsed_ms").alias("most")
    )
    k = pilot + F.col("section_pos")
    audits = pilot_sections(spark, sf_dir).groupBy("pilot_id").agg(
        F.count("*").alias("audited"), F.count_if(k % 4 != 0).alias("passed"), F.sum(k % 6).alias("cited")
    )
    none = F.lit(0).cast("bigint")
    audited, passed, cited = (F.coalesce(c, none) for c in ("audited", "passed", "cited"))
    smoke = (pilot % 17) != 0
    return seen.join(slow, "pilot_id").join(audits, "pilot_id", "left").select(
        "pilot_id",
        F.concat(F.lit("CALL-"), (pilot % 9).cast("string")).alias("call_id"),
        F.concat(F.lit("Pilot proposal "), pilot.cast("string")).alias("proposal_title"),
        F.timestamp_seconds(1_700_000_000 + pilot * 3600).alias("generated_at"),
        F.when(pilot % 3 == 0, F.concat(F.lit("note "), pilot.cast("string"))).alias("notes"),
        F.when(smoke, 0).otherwise(1).alias("smoke_exit_code"),
        F.when(~smoke, F.concat(F.lit("probe "), pilot.cast("string"), F.lit(" got out"))).alias("smoke_detail"),
        F.struct(
            audited.alias("audited_drafts"), passed.alias("passed_drafts"), (audited - passed).alias("failed_drafts"), cited.alias("citation_count")
        ).alias("audit"),
        F.struct(
            F.lit("stub").alias("runtime"), F.lit("deterministic-stub-v1").alias("llm_model"), F.lit("hash-384").alias("embedder"),
            F.lit("linux").alias("platform"),
        ).alias("runtime"),
        F.when(pilot % 5 != 2, F.struct(
            F.col("n").alias("chunk_count"), F.col("total").alias("elapsed_ms"),
            F.when(F.col("total") == 0, 0.0).otherwise(F.col("n") / (F.col("total") / 1000.0)).alias("chunks_per_second"),
        )).alias("indexing"),
        F.when(pilot % 7 != 3, F.struct(
            F.lit(5).alias("top_k"), F.col("n").alias("query_count"), F.col("mean").alias("elapsed_ms_avg"),
            F.bround("percentile", 0).cast("bigint").alias("elapsed_ms_p95"),
        )).alias("retrieval"),
        F.when(pilot % 4 != 1, F.struct(
            element(vocab.SECTION_TYPES, pilot % 11).alias("section_type"), F.col("most").alias("elapsed_ms"),
            (pilot % 6).alias("citation_count"), (F.col("n") * 100).alias("prompt_length"),
        )).alias("generation"),
    )


def pilot_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each pilot: users with an id divisible by 19 have none."""
    ps = pilots(spark, sf_dir).select("pilot_id")
    count = F.when(F.col("pilot_id") % 19 != 0, (1 + F.col("pilot_id") % 3).cast("int")).otherwise(0)
    return ps.filter(count > 0).select(
        "pilot_id", F.explode(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).alias("section_pos")
    ).select(
        "pilot_id", "section_pos", element(vocab.SECTION_TYPES, F.col("section_pos")).alias("section_type")
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinator rating per event; some are pending, some name a section that is not there."""
    e = table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    return e.select(
        event.alias("rating_id"),
        user.alias("pilot_id"),
        element(vocab.SECTION_TYPES, event % 4).alias("section_type"),
        F.concat(F.lit("coord_"), (event % 7).cast("string")).alias("coordinator_id"),
        F.when(event % 10 != 3, (5 - F.when(user % 2 == 0, event % 2).otherwise(event % 4)).cast("int")).alias("rating"),
        F.when(event % 4 != 2, (event % 90).cast("int")).alias("time_saved_minutes"),
    )


def measurements(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *more,
        F.col("event_type").alias("probe"),
        F.floor("value").cast("int").alias("elapsed_ms"),
        (F.col("event_id") % 6).alias("result_count"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of the four usage types, with every kind of schema violation."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    section = element(vocab.SECTION_TYPES, e % 11)
    flaw = e % 50
    started = F.concat(
        F.lit('"event_type": "draft_started", "section_type": "'), section,
        F.lit('", "top_k_examples": '), s(F.when(flaw == 7, 0).otherwise(1 + e % 20)),
        F.lit(', "lessons_learned": '), s(e % 2 == 0),
        F.when(flaw == 11, "").otherwise(', "model": "m1"'),
        F.lit(', "drafting_profile": null, "topic_context_present": false'),
    )
    completed = F.concat(
        F.lit('"event_type": "draft_completed", "section_type": "'), section,
        F.lit('", "generation_time_ms": '), F.when(flaw == 13, F.lit('"slow"')).otherwise(s(F.floor("value"))),
        F.lit(', "citation_count": '), s(F.when(flaw == 17, -1).otherwise(e % 6)),
        F.lit(', "source_status_mix": {"funded": '), s(e % 6), F.lit('}, "model": "m2", "iteration_count": '), s(1 + e % 5),
    )
    export = F.concat(F.lit('"event_type": "export", "kind": "markdown", "byte_count": '), s(F.floor(F.col("value") * 10)))
    feedback = F.concat(
        F.lit('"event_type": "'), F.when(flaw == 19, "comment").otherwise("feedback"),
        F.lit('", "feedback_type": "thumbs_up", "accepted": '), s(e % 3 == 0),
    )
    body = F.when(e % 4 == 0, started).when(e % 4 == 1, completed).when(e % 4 == 2, export).otherwise(feedback)
    line = F.concat(
        F.lit("{"), body, F.lit(', "timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'),
        F.when(flaw == 0, ', "user_intent": "secret"').when(flaw == 26, ', "snippet": ["x"]').otherwise(""),
        F.when(flaw == 33, "").otherwise("}"),
    )
    events = table(spark, sf_dir, "events", spread=True)
    return events.select(e.alias("event_id"), line.alias("value"))


ALLOWLIST = (
    (0, "EC.europa.eu", 443, "portal"),
    (1, "thther.example.org", 443, "mirror"),
    (2, "thther.example.org", 443, "second entry for the same host"),
    (3, "therha.example.com", 80, "plain mirror"),
)
LOOPBACKS = ("localhost", "127.0.0.1", "[::1]", "::ffff:127.0.0.9", "127.1", "LOCALHOST ", "128.0.0.1", "0:0:0:0:0:0:0:1")


def allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALLOWLIST), "position int, host string, port int, reason string")


def egress_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outbound call per page link, and loopback spellings on every fourth page."""
    p = table(spark, sf_dir, "pages")
    page = F.col("page_id")
    scheme = F.regexp_extract("url", r"\A([a-z]+)://", 1)
    host = F.regexp_extract("url", r"\A[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"\A[a-z]+://[^/?#]*(.*)\z", 1)
    return p.select(
        "page_id",
        F.timestamp_seconds(F.lit(1_700_000_000) + page * 61).alias("ts"),
        F.when(page % 4 == 3, element(LOOPBACKS, F.floor(page / 4) % 8)).otherwise(F.initcap(host)).alias("host"),
        F.when(scheme == "https", 443).otherwise(80).alias("port"),
        F.upper(scheme).alias("scheme"),
        path.alias("path"),
        F.concat(F.lit("job_"), (page % 3).cast("string")).alias("source"),
    )
