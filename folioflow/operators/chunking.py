"""Sections to overlapping, boundary-aware chunks.

A parsed document is one row (see ``structure``), so its chunks, including the running
``chunk_index`` over all sections, come from array expressions inside the row. The job is
scan, project, generate: no shuffle and no window at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.ids import chunk_id
from folioflow.functions.rows import unnest
from folioflow.functions.text import infer_section_type, is_blank, let
from folioflow.operators.structure import table_text

SPANS = "array<struct<char_start: int, char_end: int>>"
#: Metadata of a proposal in the order records keep it; `outcome` is a chunk's `source_status`.
PROPOSAL_COLUMNS = (
    "programme", "call_id", "topic_id", "year", "outcome", "proposal_title", "consortium_acronym",
    "source_path", "language", "ingested_at", "content_hash",
)


@dataclass(frozen=True)
class ChunkSizes:
    """Chunking parameters, in characters; checked before any plan is built."""

    target: int = vocab.TARGET_CHARS
    overlap: int = vocab.OVERLAP_CHARS
    minimum: int = vocab.MIN_CHUNK_CHARS
    tolerance: int = vocab.BREAK_TOLERANCE

    def __post_init__(self) -> None:
        if self.target <= 0:
            raise ValueError(f"target must be positive, got {self.target}")
        if not 0 <= self.overlap < self.target:
            raise ValueError(f"overlap must lie in [0, target), got {self.overlap}")
        if self.minimum < 0:
            raise ValueError(f"minimum must not be negative, got {self.minimum}")
        if self.tolerance < 0:
            raise ValueError(f"tolerance must not be negative, got {self.tolerance}")

    @property
    def block(self) -> int:
        """Width of the text blocks used for constant-time access."""
        return max(1024, 2 * self.tolerance)

    @property
    def least_step(self) -> int:
        """The cursor advances at least this far per span."""
        return max(1, min(self.target, self.target - self.tolerance + 1) - self.overlap)


def _blocks(text: Column, sizes: ChunkSizes) -> Column:
    """Text cut into equal blocks: reading around a position touches two blocks instead of
    scanning the text from its start, which keeps long sections linear."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % sizes.block), F.lit(0))


def _read(blocks: Column, start: Column, stop: Column, sizes: ChunkSizes) -> Column:
    """Characters ``[start, stop)``."""
    first = F.floor(start / sizes.block).cast("int")
    last = F.floor((stop - 1) / sizes.block).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.substr(joined, start - first * sizes.block + 1, stop - start)


def _break_near(blocks: Column, at: Column, length: Column, sizes: ChunkSizes) -> Column:
    """End of the last occurrence of the strongest boundary marker around ``at``."""
    low = F.greatest(F.lit(0), at - sizes.tolerance)
    high = F.least(length, at + sizes.tolerance)

    def search(mirrored: Column) -> Column:
        # the last marker in the window is the first one in the mirrored window
        hits = [
            (F.instr(mirrored, F.lit(m[::-1])), m) for m in vocab.BREAK_MARKERS
        ]
        return F.coalesce(*[F.when(p > 0, high - p + 1) for p, _ in hits], at)

    return F.when(at >= length, length).otherwise(
        let(F.reverse(_read(blocks, low, high, sizes)), search)
    )


def text_spans(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """array<struct<char_start, char_end, text>> covering ``text`` with overlap."""

    def spans(bound: Column) -> Column:
        blocks, n = bound["blocks"], bound["n"]
        start = F.struct(
            F.lit(0).alias("cursor"), F.array().cast(SPANS).alias("spans")
        )

        def step(acc: Column, _i: Column) -> Column:
            cursor = acc["cursor"]

            def emit(end: Column, following: Column) -> Column:
                span = F.struct(cursor.alias("char_start"), end.alias("char_end"))
                return F.struct(
                    following.alias("cursor"),
                    F.concat(acc["spans"], F.array(span)).alias("spans"),
                )

            def forward(found: Column) -> Column:
                end = F.when(found > cursor, found).otherwise(
                    F.least(cursor + sizes.target, n)
                )
                return let(end, lambda e: emit(e, F.greatest(e - sizes.overlap, cursor + 1)))

            return (
                F.when(cursor >= n, acc)
                .when(n - cursor <= sizes.target, emit(n, n))
                .otherwise(
                    let(_break_near(blocks, cursor + sizes.target, n, sizes), forward)
                )
            )

        steps = F.sequence(F.lit(0), F.floor(n / sizes.least_step).cast("int") + 1)
        raw = F.aggregate(steps, start, step, lambda acc: acc["spans"])
        return let(raw, lambda s: _merge_tail(s, sizes))

    def cut(bound: Column) -> Column:
        return F.transform(
            spans(bound),
            lambda s: F.struct(
                s["char_start"].alias("char_start"),
                s["char_end"].alias("char_end"),
                _read(bound["blocks"], s["char_start"], s["char_end"], sizes).alias("text"),
            ),
        )

    body = F.coalesce(text, F.lit(""))
    return let(F.struct(_blocks(body, sizes).alias("blocks"), F.length(body).alias("n")), cut)


def _merge_tail(spans: Column, sizes: ChunkSizes) -> Column:
    """A last span below the minimum is merged into the one before it."""
    count = F.size(spans)
    tail = F.get(spans, count - 1)
    before = F.get(spans, count - 2)
    merged = F.struct(before["char_start"].alias("char_start"), tail["char_end"].alias("char_end"))
    short = (count >= 2) & (tail["char_end"] - tail["char_start"] < sizes.minimum)
    return F.when(
        short, F.concat(F.slice(spans, F.lit(1), F.greatest(count - 2, F.lit(0))), F.array(merged))
    ).otherwise(spans)


def _section_chunks(section: Column, pos: Column, sizes: ChunkSizes) -> Column:
    """Body chunks, then one chunk per table, of one section."""

    def row(text: Column, page: Column, start: Column, end: Column, is_table: bool) -> Column:
        return F.struct(
            pos.alias("section_pos"),
            section["heading"].alias("heading"),
            F.lit(is_table).alias("is_table"),
            page.alias("page"),
            start.alias("char_start"),
            end.alias("char_end"),
            text.alias("text"),
        )

    none = F.lit(None).cast("int")
    body = F.transform(
        text_spans(section["text"], sizes),
        lambda s: row(s["text"], section["page_start"], s["char_start"], s["char_end"], False),
    )
    tables = F.transform(
        section["tables"],
        lambda t: row(
            table_text(t["rows"]), F.coalesce(t["page"], section["page_start"]), none, none, True
        ),
    )
    return F.concat(body, tables)


def chunk_documents(parsed: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """Parsed documents (document_id, sections, …) to chunks.

    Blank pieces are dropped before numbering, so ``chunk_index`` has no gaps. Columns of
    ``parsed`` other than ``sections`` (metadata joined beforehand) ride along.
    """
    carried = [c for c in parsed.columns if c != "sections"]
    pieces = F.filter(
        F.flatten(
            F.transform("sections", lambda s, i: _section_chunks(s, i, sizes))
        ),
        lambda p: ~is_blank(p["text"]),
    )
    exploded = unnest(parsed, pieces, *carried, pos="chunk_index", item="piece")
    flat = exploded.select(*carried, "chunk_index", "piece.*")
    return flat.select(
        chunk_id(F.col("document_id"), F.col("heading"), F.col("chunk_index")).alias("chunk_id"),
        *carried,
        "chunk_index",
        "section_pos",
        F.col("heading").alias("section_heading"),
        infer_section_type(F.col("heading")).alias("section_type"),
        "is_table",
        "page",
        "char_start",
        "char_end",
        "text",
    )


def with_proposals(parsed: DataFrame, proposals: DataFrame) -> DataFrame:
    """Give every document its proposal's metadata; ``source_status`` is the outcome.

    Joined per document, before chunks fan out. Document ids are unique on both sides, so
    no key is hot; Catalyst broadcasts ``proposals`` only below its size threshold.
    """
    dims = proposals.select("document_id", *PROPOSAL_COLUMNS).withColumnRenamed("outcome", "source_status")
    return parsed.select("document_id", "sections").join(dims, "document_id")


def chunk_anchor(chunks: DataFrame) -> DataFrame:
    """Chunks in nested form: proposal, anchor and section metadata as structs."""
    return chunks.select(
        "chunk_id",
        "text",
        F.struct(
            F.struct(
                *[F.col("source_status").alias(n) if n == "outcome" else F.col(n) for n in PROPOSAL_COLUMNS]
            ).alias("proposal"),
            "section_type",
            F.col("section_heading").alias("parent_section_heading"),
            "chunk_index",
            F.struct("document_id", "section_heading", "page", "char_start", "char_end").alias(
                "anchor"
            ),
            "source_status",
        ).alias("metadata"),
    )
