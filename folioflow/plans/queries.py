"""Registered queries: every operator applied to the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions import ids, network, portal, text, topics
from folioflow.functions.rows import unnest
from folioflow.operators import (
    audit,
    chunking,
    citations,
    dedup,
    egress,
    embedding,
    events,
    iterations,
    latency,
    maintenance,
    prompts,
    ratings,
    release,
    rendering,
    retrieval,
    similarity,
    structure,
    validation,
)
from folioflow.operators.lineage import broadcast_if_small, materialise, stored
from folioflow.plans import views
from folioflow.sources import dimensions, documents, event_log, reports, sidecars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn



# --- structure -----------------------------------------------------------------------------


@query
def layout_sections(spark, d):
    """Sections out of ordered layout items."""
    parsed = structure.parse_structure(views.layout(spark, d))
    return structure.explode_sections(parsed).drop("tables")


@query
def document_titles(spark, d):
    return structure.parse_structure(views.layout(spark, d)).select("document_id", "title")


@query
def table_grids(spark, d):
    """Sparse cells to dense grids, as text."""
    grids = unnest(
        views.layout(spark, d), structure.tables_of(F.col("raw_tables")), "document_id", item="t"
    )
    return grids.select(
        "document_id",
        F.col("t.page").alias("page"),
        F.size("t.rows").cast("bigint").alias("rows"),
        structure.table_text(F.col("t.rows")).alias("table_text"),
    )


@query
def table_sections(spark, d):
    """The section each table lands in."""
    parsed = structure.parse_structure(views.layout(spark, d))
    rows = unnest(
        structure.explode_sections(parsed),
        F.col("tables"),
        "document_id",
        "section_pos",
        "heading",
        item="t",
    )
    return rows.select("document_id", "section_pos", "heading", F.col("t.page").alias("page"))


@query
def parse_summary(spark, d):
    return structure.parse_summary(structure.parse_structure(views.layout(spark, d)))


# --- chunking --------------------------------------------------------------------------------


@query
def chunk_table(spark, d):
    return views.chunks(spark, d).drop(
        "topic_id", "year", "proposal_title", "consortium_acronym", "source_path", "language", "ingested_at", "content_hash"
    )


@query
def chunk_spans(spark, d):
    """Span offsets alone, with non-default sizes."""
    sizes = chunking.ChunkSizes(target=300, overlap=60, minimum=50, tolerance=40)
    sections = structure.explode_sections(views.parsed_documents(spark, d))
    spans = chunking.text_spans(F.col("text"), sizes)
    rows = unnest(sections, spans, "document_id", "section_pos", pos="k", item="span")
    return rows.select("document_id", "section_pos", "k", "span.char_start", "span.char_end")


@query
def section_types(spark, d):
    headings = structure.explode_sections(views.parsed_documents(spark, d))
    return headings.groupBy(text.infer_section_type(F.col("heading")).alias("section_type")).agg(
        F.count("*").alias("sections")
    )


@query
def document_metadata(spark, d):
    """Parsed documents joined with separately stored proposal metadata."""
    joined = chunking.with_proposals(
        views.parsed_documents(spark, d), views.proposals(spark, d)
    )
    fields = [c for c in joined.columns if c not in ("sections", "ingested_at")]
    return joined.select(
        *fields, text.iso_utc(F.col("ingested_at")).alias("ingested_at"), F.size("sections").cast("bigint").alias("sections")
    )


# --- text functions ----------------------------------------------------------------------------


def _topic_contexts(spark, d) -> DataFrame:
    return views.call_texts(spark, d).select(
        "doc_id", topics.topic_context(F.col("text")).alias("topic")
    )


@query
def topic_fields(spark, d):
    t = _topic_contexts(spark, d)
    return t.select(
        "doc_id",
        "topic.programme",
        "topic.call_id",
        "topic.topic_id",
        "topic.topic_title",
        "topic.destination",
        "topic.scope",
        "topic.source",
        F.length("topic.raw_text").cast("bigint").alias("raw_length"),
        topics.topic_is_empty(F.col("topic")).alias("is_empty"),
    )


@query
def topic_outcomes(spark, d):
    t = _topic_contexts(spark, d)
    return unnest(t, F.col("topic.expected_outcomes"), "doc_id", pos="n", item="outcome")


@query
def topic_guidance(spark, d):
    entries = F.map_entries("topic.section_guidance")
    rows = unnest(_topic_contexts(spark, d), entries, "doc_id", item="e")
    return rows.select(
        "doc_id", F.col("e.key").alias("section_type"), F.col("e.value").alias("guidance")
    )


@query
def parsed_topic_fields(spark, d):
    """Topic fields out of a parsed document flattened to text."""
    flat = views.parsed_documents(spark, d).select(
        "document_id", topics.flatten_parsed(F.col("title"), F.col("sections")).alias("flat")
    )
    t = flat.select(
        "document_id",
        ids.content_hash(F.col("flat")).alias("flat_hash"),
        topics.topic_context(F.col("flat"), F.col("document_id")).alias("topic"),
    )
    return t.select(
        "document_id", "flat_hash", "topic.programme", "topic.call_id", "topic.topic_id",
        "topic.source", "topic.source_path",
    )


@query
def upload_suggestions(spark, d):
    names = views.file_names(spark, d)
    s = names.select(
        "doc_id",
        topics.metadata_suggestion(F.col("file_name"), F.concat(F.lit("A title for HE-"), "source")).alias("s"),
    )
    return s.select("doc_id", "s.*")


@query
def file_name_metadata(spark, d):
    """Metadata for files without a sidecar: defaults, file name, overrides, path."""
    overrides = {"year": F.when(F.col("doc_id") % 2 == 0, (2015 + F.col("doc_id") % 9).cast("int")), "language": F.col("lang")}
    names = views.file_names(spark, d)
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "file_name")
    return names.select(
        "doc_id", topics.synthesised_metadata(path, overrides).alias("m")
    ).select("doc_id", "m.*")


@query
def portal_topics(spark, d):
    links = views.portal_links(spark, d)
    return links.select("page_id", portal.portal_topic(F.col("url")).alias("t")).select(
        "page_id", "t.topic_id", "t.reason"
    )


@query
def portal_contexts(spark, d):
    """The search result that names exactly the page's topic."""
    links = views.portal_links(spark, d)
    topic = F.format_string(
        "HORIZON-CL%d-2026-%06d-A", F.col("page_id") % 9, F.col("page_id")
    )
    return links.select(
        "page_id", portal.call_context(F.col("payload"), topic).alias("c")
    ).select("page_id", "c.*")


@query
def chunk_snippets(spark, d):
    c = views.chunks(spark, d)
    return c.select(
        "chunk_id",
        text.snippet(F.col("text")).alias("snippet"),
        text.snippet(F.col("text"), vocab.LISTING_SNIPPET_CHARS).alias("listing_snippet"),
    )


@query
def citation_labels(spark, d):
    """Humanised codes, placeholders and pipe escapes of every citation."""
    c = unnest(views.drafts(spark, d), F.col("citations"), "draft_path", item="c")
    return c.select(
        "draft_path",
        "pos",
        text.humanise(F.col("c.programme")).alias("programme"),
        text.page_note(F.col("c.page")).alias("page"),
        text.section_or_na(F.col("c.section_heading")).alias("section"),
        text.title_or_untitled(F.col("c.proposal_title")).alias("title"),
        text.escape_pipes(F.col("c.call_id")).alias("call_id"),
    )


@query
def text_markers(spark, d):
    """Every marker of every draft, bounded and unbounded."""
    t = views.drafts(spark, d)
    return t.select(
        "draft_path",
        F.array_join(text.citation_markers(F.col("text")), ",").alias("markers"),
        F.array_join(text.citation_markers(F.col("text"), 2), ",").alias("short_markers"),
    )


@query
def allowlist_hosts(spark, d):
    """Host normalisation and refusal reasons, over the hosts of all pages."""
    p = views.table(spark, d, "pages")
    host = F.regexp_extract("url", r"\A[a-z]+://([^/?#]*)", 1)
    k = F.col("page_id") % 5
    entry = (
        F.when(k == 0, F.concat(F.lit(" "), F.upper(host), F.lit("\t")))
        .when(k == 1, F.col("url"))
        .when(k == 2, F.concat(host, F.lit("/path")))
        .when(k == 3, F.concat(host, F.lit(" x")))
        .otherwise(" ")
    )
    return p.select("page_id", network.allowlist_host(entry).alias("h")).select(
        "page_id", "h.host", "h.reason"
    )


@query
def source_paths(spark, d):
    """Document ids, archive names, extension test and path resolution."""
    p = views.proposals(spark, d).join(
        views.file_names(spark, d).select("doc_id", "file_name"), "doc_id"
    )
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/abs/"), "file_name")).otherwise(F.col("source_path"))
    staged = F.concat(F.lit("tok__"), "file_name")
    return p.select(
        "doc_id",
        ids.document_id(F.concat(F.lit("in/a.b/"), "file_name")).alias("file_document_id"),
        ids.is_pdf(F.col("file_name")).alias("is_pdf"),
        ids.resolve_source_path(path, F.lit("/meta/side/doc.json")).alias("resolved"),
        ids.archive_name(
            F.col("programme"), F.concat(F.col("call_id"), F.lit("/x\\y")), F.col("topic_id"),
            staged, F.when(F.col("doc_id") % 2 == 0, "tok").otherwise("other"),
        ).alias("archive_name"),
    )


@query
def content_hashes(spark, d):
    t = views.table(spark, d, "documents", spread=True)
    return t.select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query
def flat_metadata(spark, d):
    """Nested chunk metadata flattened to dotted columns, after a nest / flatten round trip."""
    nested = chunking.chunk_anchor(views.chunks(spark, d))
    again = documents.unflatten_metadata(documents.flatten_metadata(nested))
    return documents.flatten_metadata(again).drop("text")


@query
def sidecar_metadata(spark, d):
    """Proposal fields of YAML sidecars, and what is wrong with unreadable ones."""
    rows = sidecars.sidecar_rows(views.sidecar_texts(spark, d), "sidecar_text", "doc_id")
    return rows.withColumn("ingested_at", text.iso_utc(F.col("ingested_at")))


# --- validation ------------------------------------------------------------------------------------


@query
def proposal_validation(spark, d):
    p = views.proposals(spark, d)
    k = F.col("doc_id")
    spoiled = p.select(
        "doc_id",
        F.when(k % 11 == 3, "fp7").when(k % 11 == 4, F.lit(None)).otherwise(F.col("programme")).alias("programme"),
        F.when(k % 13 == 5, " \t").otherwise(F.concat(F.lit(" "), "call_id")).alias("call_id"),
        F.when(k % 17 == 1, 2013).when(k % 17 == 2, 2100).otherwise(F.col("year")).alias("year"),
        F.when(k % 19 == 1, "won").otherwise(F.col("outcome")).alias("outcome"),
        F.when(k % 23 == 1, "").otherwise(F.col("source_path")).alias("source_path"),
        F.when(k % 7 == 1, F.upper("content_hash")).when(k % 7 == 2, F.lit(None)).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return validation.clean_proposals(spoiled).select(
        "doc_id", "call_id", F.array_join("reasons", ",").alias("reasons")
    )


@query
def chunk_validation(spark, d):
    c = views.chunks(spark, d)
    k = F.col("chunk_index")
    spoiled = c.withColumns(
        {
            "outcome": F.col("source_status"),
            "section_type": F.when(k % 11 == 3, "annex").otherwise(F.col("section_type")),
            "source_status": F.when(k % 7 == 3, "funded").when(k % 7 == 5, "lost").otherwise(F.col("source_status")),
            "page": F.when(k % 5 == 4, 0).otherwise(F.col("page")),
            "char_end": F.when(k % 9 == 2, F.col("char_start") - 1).otherwise(F.col("char_end")),
        }
    )
    return spoiled.select(
        "chunk_id", F.array_join(validation.chunk_errors(F.col("outcome")), ",").alias("reasons")
    )


@query
def event_validation(spark, d):
    checked = validation.check_events(views.usage_events(spark, d))
    return checked.select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query
def vector_width(spark, d):
    """Vectors of the wrong width are turned away."""
    e = views.table(spark, d, "embeddings")
    spoiled = e.withColumn(
        "embedding",
        F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding")),
    )
    good, bad = embedding.split_by_width(spoiled, 64)
    tagged = good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("accepted", F.lit(False))
    )
    return tagged.select("vec_id", F.size("embedding").cast("bigint").alias("width"), "accepted")


@query
def request_validation(spark, d):
    r = views.search_requests(spark, d)
    k = F.col("query_id")
    spoiled = r.withColumns(
        {
            "top_k": F.when(k % 6 == 1, 0).when(k % 6 == 2, 101).when(k % 6 == 3, 21).otherwise(F.col("top_k")),
            "programme": F.when(k % 9 == 4, "fp7").otherwise(F.col("programme")),
            "query": F.when(k % 8 == 5, "  ").otherwise(F.col("query")),
        }
    )
    return spoiled.select(
        "query_id",
        F.array_join(validation.request_errors(100), ",").alias("search_reasons"),
        F.array_join(validation.request_errors(20), ",").alias("drafting_reasons"),
    )


@query
def result_count_check(spark, d):
    """Drafts whose declared number of citations differs from the listed one."""
    t = views.drafts(spark, d)
    rows = unnest(t, F.col("citations"), "draft_path").withColumnRenamed("draft_path", "query_id")
    declared = t.select(
        F.col("draft_path").alias("query_id"),
        ((F.col("draft_id") + 2 * F.col("iteration") - 1) % 6 + F.when(F.col("draft_id") % 5 == 2, 1).otherwise(0)).alias("result_count"),
    )
    return validation.result_count_mismatches(declared, rows)


# --- embedding and similarity ------------------------------------------------------------------------


def _checksum(vector: str) -> F.Column:
    """Order-sensitive fingerprint of a vector."""
    weighted = F.transform(vector, lambda w, i: w.cast("double") * (i + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x), 4)


@query
def hash_vectors(spark, d):
    v = views.embedded_chunks(spark, d)
    return v.select(
        "chunk_id",
        F.size(F.filter("embedding", lambda w: w != 0)).cast("bigint").alias("buckets"),
        _checksum("embedding").alias("checksum"),
    )


@query
def model_vectors(spark, d):
    """A pluggable model: character, word and line counts as a three-wide vector."""

    def load():
        return lambda batch: [[len(t), len(t.split(" ")), t.count("\n") + 1] for t in batch]

    t = views.table(spark, d, "documents", spread=True)
    v = t.select("doc_id", embedding.model_embedding(F.col("text"), load, dim=3).alias("v"))
    return v.select("doc_id", *[F.get("v", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("chars", "words", "lines"))])


@query
def missing_vectors(spark, d):
    """Chunks that carry a vector keep it, the others get one."""
    c = views.chunks(spark, d)
    supplied = F.when(F.col("chunk_index") % 2 == 0, F.array_repeat(F.lit(0.5), 4).cast("array<float>"))
    filled = embedding.embed_missing(c.withColumn("embedding", supplied))
    return filled.select(
        "chunk_id",
        F.size("embedding").cast("bigint").alias("width"),
        _checksum("embedding").alias("checksum"),
    )


@query
def cosine_neighbours(spark, d):
    """Similarity of each vector to the next one by id."""
    e = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select(
        "vec_id", F.round(embedding.cosine(F.col("embedding"), F.col("other")), 6).alias("score")
    )


def _vector_search(spark, d, filters=(), **how) -> DataFrame:
    e = views.table(spark, d, "embeddings", spread=True).select(
        "vec_id", "embedding", F.col("label").cast("string").alias("label")
    )
    queries = e.select(F.col("vec_id").alias("query_id"), F.lit(5).alias("n"), "embedding", "label")
    found = similarity.top_n(e, queries, id_column="vec_id", filter_columns=filters, **how)
    return found.select("query_id", F.col("vec_id").alias("match_id"), F.round("score", vocab.SCORE_DIGITS).alias("score"))


@query
def vector_top_k(spark, d):
    """Five nearest vectors of every vector."""
    return _vector_search(spark, d)


@query
def vector_top_k_same_label(spark, d):
    """Five nearest vectors within the query's own label."""
    return _vector_search(spark, d, filters=("label",))


@query
def vector_top_k_blocks(spark, d):
    """The same search in several blocks of queries, with lower bounds from a part of the tasks."""
    return _vector_search(spark, d, block_queries=200, strides=(4,))


# --- retrieval -----------------------------------------------------------------------------------------

LENIENT = retrieval.RetrievalPolicy(relevance_threshold=0.05, max_rejected_fraction=1.0)
CAUTIOUS = retrieval.RetrievalPolicy(
    relevance_threshold=0.2,
    rejected_threshold_offset=-0.15,
    lessons_learned_mode=True,
    include_esr=False,
    funded_first=False,
    max_rejected_fraction=0.29,
)


@query
def candidate_pools(spark, d):
    requests = retrieval.resolve_requests(
        views.search_requests(spark, d), retrieval.RetrievalPolicy()
    )
    found = retrieval.candidate_pool(views.embedded_chunks(spark, d), requests)
    return found.withColumn("score", F.round("score", vocab.SCORE_DIGITS))


@query
def policy_retrieval(spark, d):
    """Ranked evidence for every request under the default policy."""
    return retrieval.retrieve(views.embedded_chunks(spark, d), views.search_requests(spark, d))


@query
def policy_retrieval_lenient(spark, d):
    return retrieval.retrieve(
        views.embedded_chunks(spark, d), views.search_requests(spark, d), LENIENT
    )


@query
def policy_retrieval_cautious(spark, d):
    return retrieval.retrieve(
        views.embedded_chunks(spark, d), views.search_requests(spark, d), CAUTIOUS
    )


# --- duplicates and maintenance --------------------------------------------------------------------------


def _indexed(spark, d) -> DataFrame:
    return views.proposals(spark, d).select(
        "document_id", "content_hash", "proposal_title", "call_id"
    )


@query
def hash_lookup(spark, d):
    return dedup.by_content_hash(_indexed(spark, d))


@query
def title_call_lookup(spark, d):
    return dedup.by_title_and_call(_indexed(spark, d))


@query
def chunks_per_document(spark, d):
    return dedup.by_document_id(views.chunks(spark, d))


@query
def document_registry(spark, d):
    """One row per indexed document, recovered from its chunks."""
    return dedup.registry(views.chunks(spark, d))


@query
def duplicate_decisions(spark, d):
    return dedup.decide_duplicates(views.incoming(spark, d), _indexed(spark, d)).select(
        "position", "document_id", "action", "conflicting_document_id"
    )


@query
def duplicate_admission(spark, d):
    decisions = dedup.decide_duplicates(views.incoming(spark, d), _indexed(spark, d))
    both = dedup.admission(decisions).withColumn("forced", F.lit(False)).unionByName(
        dedup.admission(decisions, force=True).withColumn("forced", F.lit(True))
    )
    return both.select("position", "forced", "outcome", "replaced_document_id")


@query
def batch_decisions(spark, d):
    """Decisions in batch order, each seeing what the batch admitted before."""
    return dedup.decide_batch(views.incoming(spark, d), _indexed(spark, d)).select(
        "position", "document_id", "action", "conflicting_document_id"
    )


@query
def batch_decisions_forced(spark, d):
    """The same with `force`: a suspected duplicate replaces the record it conflicts with."""
    decided = dedup.decide_batch(views.incoming(spark, d), _indexed(spark, d), force=True)
    return dedup.survivors(dedup.admission(decided, force=True)).select(
        "position", "document_id", "action", "conflicting_document_id", "outcome", "stays"
    )


@query
def batch_outcomes(spark, d):
    decisions = dedup.decide_batch(views.incoming(spark, d), _indexed(spark, d))
    counts = views.chunks(spark, d).groupBy(
        F.replace("document_id", F.lit("doc_"), F.lit("")).cast("bigint").alias("position")
    ).agg(F.count("*").alias("chunk_count"))
    return dedup.batch_summary(dedup.admission(decisions), counts)


def _chunk_rows(spark, d) -> DataFrame:
    return views.chunks(spark, d).select("chunk_id", "document_id", "text")


def _revised(rows: DataFrame) -> DataFrame:
    """A second version of every chunk: odd ones keep their id, even ones get a new one."""
    odd = F.length("text") % 2 == 1
    return rows.select(
        F.when(odd, F.col("chunk_id")).otherwise(F.concat("chunk_id", F.lit("-v2"))).alias("chunk_id"),
        "document_id",
        F.concat("text", F.lit(" v2")).alias("text"),
    )


def _fingerprint(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_id", "document_id", F.sha2("text", 256).alias("text_hash"))


@query
def chunk_upsert(spark, d):
    rows = _chunk_rows(spark, d)
    return _fingerprint(maintenance.upsert(rows, _revised(rows)))


def _decided_reindex(spark, d) -> DataFrame:
    decisions = dedup.decide_duplicates(views.incoming(spark, d), _indexed(spark, d))
    return dedup.admission(decisions).filter("outcome = 'reindexed'").select(
        F.col("replaced_document_id").alias("document_id")
    )


@query
def chunk_deletes(spark, d):
    """Chunks every presented document id would lose."""
    return maintenance.removed_counts(
        _chunk_rows(spark, d), views.incoming(spark, d).select("document_id")
    )


@query
def chunk_reindex(spark, d):
    """Re-indexed documents lose their old chunks and gain the revised ones."""
    rows = stored(_chunk_rows(spark, d))  # texts are cut into chunks once
    replaced = materialise(_decided_reindex(spark, d).distinct())
    new = _revised(rows.join(broadcast_if_small(replaced), "document_id", "left_semi"))
    return _fingerprint(maintenance.reindex(rows, replaced, new))


@query
def indexed_proposals(spark, d):
    """Chunk, embed and count per proposal."""
    v = views.embedded_chunks(spark, d)
    return v.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.exists("embedding", lambda w: w != 0)).alias("embedded"),
    )


@query
def collection_counts(spark, d):
    """Chunks per named collection (one collection per programme)."""
    c = views.chunks(spark, d)
    return c.groupBy(F.col("programme").alias("collection")).agg(
        F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents")
    )


# --- citations, drafts, audits ----------------------------------------------------------------------------


def _cited(spark, d) -> DataFrame:
    """Citations of the results; only documents with a result are cut into chunks a second time."""
    found = retrieval.retrieve(views.embedded_chunks(spark, d), views.search_requests(spark, d), LENIENT)
    results = materialise(found)
    hit = results.select(ids.document_of_chunk(F.col("chunk_id")).alias("document_id")).distinct()
    return citations.citation_rows(results, views.chunks(spark, d, broadcast_if_small(hit)))


@query
def retrieval_citations(spark, d):
    return _cited(spark, d)


@query
def evidence_blocks(spark, d):
    lists = citations.citation_lists(_cited(spark, d))
    requests = views.search_requests(spark, d).select("query_id")
    return requests.join(lists, "query_id", "left").select(
        "query_id", citations.evidence_text(F.col("citations")).alias("evidence")
    )


def _prompt_requests(spark, d) -> DataFrame:
    """Each request with the call text of the document that has its number, if there is one."""
    q = F.col("query_id")
    named = F.when(q % 5 != 4, q)
    requests = views.search_requests(spark, d)
    wanted = broadcast_if_small(requests.select(named.alias("doc_id")).distinct())
    calls = views.call_texts(spark, d).join(wanted, "doc_id", "left_semi").select(
        F.col("doc_id").alias("topic_key"), F.col("text").alias("call_text")
    )
    # fields are read only out of the texts that some request names
    topic = F.when(F.col("call_text").isNotNull(), topics.topic_context(F.col("call_text")))
    return (
        requests
        .withColumn("call_context", F.when(q % 3 == 0, F.concat(F.lit(" Note "), q.cast("string"))).otherwise(""))
        .withColumn("topic_key", named)
        .join(calls, "topic_key", "left")
        .withColumn("topic", topic)
    )


@query
def drafting_prompts(spark, d):
    built = prompts.build_prompts(
        _prompt_requests(spark, d),
        citations.citation_lists(_cited(spark, d)),
        dimensions.default_guidance(spark),
        dimensions.profile_guidance(spark),
    )
    return built


@query
def marker_validation(spark, d):
    checked = citations.marker_check(views.drafts(spark, d))
    return checked.withColumn("invalid_markers", F.array_join(F.col("invalid_markers").cast("array<string>"), ","))


def _audited(spark, d) -> DataFrame:
    return audit.audit_drafts(views.drafts(spark, d))


@query
def audit_findings(spark, d):
    return audit.finding_rows(_audited(spark, d))


@query
def audit_verdicts(spark, d):
    return release.draft_results(_audited(spark, d))


@query
def rendered_drafts(spark, d):
    return rendering.render(views.drafts(spark, d)).select("draft_path", "rendered")


@query
def exported_drafts(spark, d):
    return rendering.export(_audited(spark, d)).select("draft_path", "section_type", "byte_count")


@query
def release_totals(spark, d):
    return release.release_totals(_audited(spark, d))


@query
def release_citations(spark, d):
    return release.citation_audit_rows(_audited(spark, d))


@query
def release_sample(spark, d):
    return release.sample_drafts(views.drafts(spark, d), 25).select("draft_path", "section_type")


@query
def release_report(spark, d):
    """Lines of the release report in Markdown."""
    return reports.release_markdown(_audited(spark, d), "drafts")


@query
def release_report_sampled(spark, d):
    """The same over a seeded sample of 25 drafts."""
    drafts = views.drafts(spark, d)
    some = release.sample_drafts(drafts, 25)
    return reports.release_markdown(audit.audit_drafts(some), "drafts", drafts.count(), (25, release.DEFAULT_SEED))


@query
def release_gate(spark, d):
    """Per section type: blocked in a release, blocked in a smoke run."""
    a = _audited(spark, d)
    smoke = F.exists(
        "findings",
        lambda f: (f["severity"] == "error") & ~f["code"].isin(*vocab.SMOKE_TOLERATED_CODES),
    )
    return a.groupBy("section_type").agg(
        F.bool_or(audit.has_errors(F.col("findings"))).alias("release_blocked"),
        F.bool_or(smoke).alias("smoke_blocked"),
    )


@query
def release_issues(spark, d):
    return audit.error_issues(_audited(spark, d)).drop("message")


# --- iterations, ratings, measurements -----------------------------------------------------------------------


@query
def requirements(spark, d):
    t = _topic_contexts(spark, d).withColumn(
        "section_type", views.element(vocab.SECTION_TYPES, F.col("doc_id") % 11)
    ).withColumn("programme", F.col("topic.programme"))
    joined = t.join(dimensions.profile_guidance(spark), ["programme", "section_type"], "left")
    checked = iterations.requirements_checked(
        F.col("expected_outputs"), F.map_keys("topic.section_guidance")
    )
    return joined.select("doc_id", F.array_join(checked, "; ").alias("requirements"))


@query
def change_summaries(spark, d):
    r = iterations.iteration_records(views.drafts(spark, d), max_iterations=9)
    return r.select(
        "draft_id", "iteration_index", "changes_summary",
        F.sha2("critique_text", 256).alias("critique_hash"), "stopped",
    )


@query
def iteration_history(spark, d):
    r = iterations.iteration_records(views.drafts(spark, d), max_iterations=3)
    h = iterations.cumulative_history(r)
    return h.select(
        "draft_id",
        "iteration_index",
        "total_iterations",
        F.array_join(F.transform("history", lambda x: x["iteration_index"].cast("string")), ",").alias("history"),
    )


@query
def rating_attachment(spark, d):
    """Ratings per section, those of unknown sections kept apart."""
    known, unknown = ratings.attach_ratings(views.pilot_sections(spark, d), views.ratings(spark, d))
    tagged = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return tagged.groupBy("section_type", "known").agg(
        F.count("*").alias("ratings"), F.count("rating").alias("given")
    )


@query
def section_ratings(spark, d):
    o = ratings.section_outcomes(views.pilot_sections(spark, d), views.ratings(spark, d))
    return o.withColumn("mean_rating", F.round("mean_rating", 6))


@query
def pilot_verdicts(spark, d):
    o = ratings.section_outcomes(views.pilot_sections(spark, d), views.ratings(spark, d))
    return ratings.verdicts(views.pilots(spark, d), o)


@query
def pilot_report(spark, d):
    """Lines of every pilot's report in Markdown."""
    sections = views.pilot_sections(spark, d)
    rated = views.ratings(spark, d)
    known, _ = ratings.attach_ratings(sections, rated.filter(F.col("pilot_id") % 5 != 1))
    verdict = ratings.verdicts(
        views.pilots(spark, d), ratings.section_outcomes(sections, rated)
    ).join(views.pilots(spark, d).select("pilot_id", "smoke_passed"), "pilot_id").join(views.pilot_records(spark, d), "pilot_id")
    k = F.col("pilot_id") + F.col("section_pos")
    shown = sections.select(
        "*",
        (k % 6).alias("citation_count"),
        (k * 31).alias("draft_length"),
        (k % 90).alias("elapsed_ms"),
        (k % 4 != 0).alias("audit_passed"),
        F.concat(F.lit("d/"), k.cast("string")).alias("draft_path"),
    )
    issues = shown.filter(~F.col("audit_passed")).select(
        "pilot_id", "section_type", F.lit("missing_status").alias("code"), F.lit("no status").alias("message"), "draft_path"
    )
    return reports.pilot_markdown(
        verdict, shown, known.withColumn("notes", F.lit(None).cast("string")), issues
    )


@query
def section_results(spark, d):
    return ratings.section_results(_audited(spark, d))


@query
def latency_rollup(spark, d):
    r = latency.latency_rollup(views.measurements(spark, d), "probe")
    return r.withColumns(
        {c: F.round(c, 6) for c in ("elapsed_ms_avg", "result_count_avg")}
    )


@query
def indexing_throughput(spark, d):
    """Chunks per second of an indexing run per source, elapsed time from the text sizes."""
    c = views.chunks(spark, d)
    runs = c.groupBy("call_id").agg(
        F.countDistinct("document_id").alias("proposal_count"),
        F.count("*").alias("chunk_count"),
        F.floor(F.sum(F.length("text")) / 100000).alias("elapsed_ms"),
    )
    out = latency.indexing_throughput(runs)
    return out.withColumns(
        {c: F.round(c, 6) for c in ("per_proposal_ms_avg", "chunks_per_second")}
    )


@query
def generation_measurements(spark, d):
    drafts = views.drafts(spark, d).withColumn("prompt", F.col("critique"))
    return latency.generation_measurements(drafts)


@query
def guidance_coverage(spark, d):
    """Chunks per section type with the guidance and profile rows that apply."""
    counts = views.chunks(spark, d).groupBy("programme", "section_type").agg(
        F.count("*").alias("chunks")
    )
    return (
        counts.join(dimensions.default_guidance(spark), "section_type", "left")
        .join(dimensions.profile_guidance(spark), ["programme", "section_type"], "left")
        .select(
            "programme", "section_type", "chunks", "profile_name",
            F.coalesce("profile_guidance", "guidance").alias("guidance"),
            F.coalesce(F.size("expected_outputs"), F.lit(0)).cast("bigint").alias("outputs"),
        )
    )


@query
def status_notes(spark, d):
    """Labels, badges and caveats joined to the number of chunks they apply to."""
    counts = views.chunks(spark, d).groupBy("source_status").agg(F.count("*").alias("chunks"))
    return counts.join(dimensions.status_labels(spark), "source_status", "left")


# --- events and egress ----------------------------------------------------------------------------------------


def _event_time(number: str) -> F.Column:
    return F.timestamp_seconds(1_700_000_000 + F.col(number) * 7)


def _profile(programme: str) -> F.Column:
    return text.lookup(F.col(programme), {k: p["name"] for k, p in dimensions.PROFILES.items()})


def _usage_events(spark, d) -> DataFrame:
    """Events of all four types, from requests, drafts, their exports and recorded signals."""
    keep = ("origin",)
    asked = views.search_requests(spark, d).filter("section_type IS NOT NULL").withColumns(
        {"origin": F.concat(F.lit("request "), "query_id"), "topic_context_present": F.col("query_id") % 3 == 0}
    )
    drafts = views.drafts(spark, d).withColumns(
        {"origin": F.concat(F.lit("draft "), "draft_path"), "number": F.length("text").cast("bigint")}
    )
    exports = rendering.export(_audited(spark, d)).withColumn("origin", F.concat(F.lit("export "), "draft_path"))
    e = F.col("event_id")
    signals = views.table(spark, d, "events", spread=True).select(
        F.concat(F.lit("signal "), "event_id").alias("origin"), "event_id", e.cast("int").alias("seconds"),
        views.element(("thumbs_up", "thumbs_down", "regenerate"), e % 3).alias("feedback_type"), (e % 2 == 0).alias("accepted"),
        F.when(e % 5 != 0, views.element(vocab.SECTION_TYPES, e % 11)).alias("section_type"),
        F.when(e % 4 != 0, e % 6).alias("iteration_index"),
    )
    model = F.lit("deterministic-stub-v1")
    return events.usage_events(
        events.draft_started(asked, model=model, profile=_profile("programme"), keep=keep, at=_event_time("query_id")),
        events.draft_completed(drafts, model=model, profile=F.lit(None), keep=keep, at=_event_time("number")),
        events.exported(exports, kind=F.lit("markdown"), keep=keep, at=_event_time("byte_count")),
        events.feedback(signals, keep=keep, at=_event_time("event_id")),
    )


@query
def usage_event_lines(spark, d):
    """The canonical line of every usage event, all four types."""
    return events.event_lines(_usage_events(spark, d), "origin")


@query
def draft_events(spark, d):
    """Completion events of all drafts, with their source-status mix."""
    built = events.draft_completed(
        views.drafts(spark, d), model=F.lit("deterministic-stub-v1"), profile=F.lit(None), keep=("draft_path",)
    )
    return built.select(
        "draft_path", "event_type", "section_type", "generation_time_ms", F.col("citation_count").cast("bigint").alias("citation_count"),
        F.to_json("source_status_mix").alias("source_status_mix"), "iteration_count",
    )


@query
def event_export_counts(spark, d):
    """Lines an export copies (non-blank) and drops, per hour of the log."""
    e = views.usage_events(spark, d)
    line = F.when(F.col("event_id") % 9 == 4, "  \t").otherwise(F.col("value"))
    blank = ~event_log.worth_exporting(line)
    return e.groupBy((F.floor(F.col("event_id") / 1000)).alias("part")).agg(
        F.count_if(~blank).alias("exported"), F.count_if(blank).alias("blank")
    )


@query
def egress_decisions(spark, d):
    allowed, _ = egress.check_allowlist(views.allowlist(spark))
    return egress.decide_egress(views.egress_attempts(spark, d), allowed).select(
        "page_id", "host", "port", "decision", "decision_reason"
    )


@query
def egress_log(spark, d):
    allowed, _ = egress.check_allowlist(views.allowlist(spark))
    return egress.egress_records(egress.decide_egress(views.egress_attempts(spark, d), allowed))
