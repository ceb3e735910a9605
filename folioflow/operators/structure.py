"""Parsed-document structure: ordered layout items and sparse tables to sections.

A parser hands over one document at a time, so a document is one row holding its ordered
``items`` and ``raw_tables`` arrays. Everything below works inside that row with array
expressions: no shuffle, no window, and a document with very many items never meets
another document's rows.

``items``       array<struct<kind, depth, text, level, prov array<int>>>
                kind is ``title``, ``section_header`` or ``text``
``raw_tables``  array<struct<num_rows, num_cols, prov array<int>, cells array<struct<row, col, text>>>>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.rows import unnest
from folioflow.functions.text import empty_to_null, let, strip

ITEM = "struct<kind: string, depth: int, text: string, level: int, prov: array<int>>"
RAW_TABLE = (
    "struct<num_rows: int, num_cols: int, prov: array<int>, "
    "cells: array<struct<row: int, col: int, text: string>>>"
)


def first_page(prov: Column) -> Column:
    """First page number of a provenance list that is a real page (1 or more)."""
    return F.get(F.filter(prov, lambda p: p >= 1), F.lit(0))


def heading_level(level: Column) -> Column:
    return F.greatest(
        F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif(level, F.lit(0)), F.lit(1)))
    )


def _clean(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def document_title(items: Column, name: Column) -> Column:
    """First non-blank title or section header in item order, else the document name."""
    named = F.filter(
        items, lambda x: x["kind"].isin("title", "section_header") & (_clean(x["text"]) != "")
    )
    return F.coalesce(strip(F.get(named, F.lit(0))["text"]), empty_to_null(_clean(name)))


def sections_of(items: Column) -> Column:
    """Sections in item order: array<struct<heading, level, text, page_start, page_end>>.

    Every header closes the open section. A blank header opens none, so text after it, like
    text before the first header, belongs nowhere and is dropped.
    """

    def header_positions(xs: Column) -> Column:
        return F.filter(
            F.transform(xs, lambda x, i: F.when(x["kind"] == "section_header", i)),
            lambda i: i.isNotNull(),
        )

    def build(xs: Column) -> Column:
        def from_headers(at: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(at, k + 1), F.size(xs))
                body = F.filter(
                    F.slice(xs, start + 2, stop - start - 1),
                    lambda x: (x["kind"] == "text") & (x["depth"] == 1),
                )
                return let(
                    F.struct(F.get(xs, start).alias("header"), body.alias("body")), _section
                )

            return F.filter(F.transform(at, one), lambda s: s["heading"] != "")

        return let(header_positions(xs), from_headers)

    return let(items, build)


def _section(part: Column) -> Column:
    header, body = part["header"], part["body"]
    lines = F.filter(F.transform(body, lambda x: _clean(x["text"])), lambda t: t != "")
    pages = F.filter(F.transform(body, lambda x: first_page(x["prov"])), lambda p: p.isNotNull())
    header_page = first_page(header["prov"])
    return F.struct(
        _clean(header["text"]).alias("heading"),
        heading_level(header["level"]).alias("level"),
        strip(F.array_join(lines, "\n")).alias("text"),
        F.coalesce(header_page, F.get(pages, F.lit(0))).alias("page_start"),
        F.coalesce(F.try_element_at(pages, F.lit(-1)), header_page).alias("page_end"),
    )


def table_grid(table: Column) -> Column:
    """Dense rows of a sparse cell list.

    Missing cells are empty, cells outside the grid are dropped and the last cell written
    to a place wins. The grid's own empty cells take part as write number -1, so one sort
    yields the finished grid.
    """
    rows, cols = table["num_rows"], table["num_cols"]
    blank = F.transform(
        F.sequence(F.lit(0), rows * cols - 1),
        lambda k: F.struct(k.alias("place"), F.lit(-1).alias("write"), F.lit("").alias("text")),
    )
    written = F.filter(
        F.transform(
            table["cells"],
            lambda c, i: F.struct(
                F.when(
                    F.coalesce(c["row"], F.lit(0)).between(0, rows - 1)
                    & F.coalesce(c["col"], F.lit(0)).between(0, cols - 1),
                    F.coalesce(c["row"], F.lit(0)) * cols + F.coalesce(c["col"], F.lit(0)),
                ).alias("place"),
                i.alias("write"),
                _clean(c["text"]).alias("text"),
            ),
        ),
        lambda c: c["place"].isNotNull(),
    )

    def last_writes(cells: Column) -> Column:
        return F.filter(
            cells,
            lambda c, i: ~F.coalesce(F.get(cells, i + 1)["place"] == c["place"], F.lit(False)),
        )

    def cut(cells: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), rows - 1),
            lambda r: F.transform(F.slice(cells, r * cols + 1, cols), lambda c: c["text"]),
        )

    return let(let(F.sort_array(F.concat(blank, written)), last_writes), cut)


def tables_of(raw_tables: Column) -> Column:
    """array<struct<rows, page>> of the tables that have at least one row and column."""
    real = F.filter(
        F.coalesce(raw_tables, F.array().cast(f"array<{RAW_TABLE}>")),
        lambda t: (F.coalesce(t["num_rows"], F.lit(0)) > 0)
        & (F.coalesce(t["num_cols"], F.lit(0)) > 0),
    )
    return F.transform(
        real, lambda t: F.struct(table_grid(t).alias("rows"), first_page(t["prov"]).alias("page"))
    )


def section_for_page(sections: Column, page: Column) -> Column:
    """Position of the section a table on ``page`` belongs to.

    The first section whose page span contains it; else the last one that starts on or
    before it; else, and for a table without a page, the last section.
    """
    last = F.size(sections) - 1
    positions = F.sequence(F.lit(0), last)
    inside = F.filter(
        positions,
        lambda i: page.between(F.get(sections, i)["page_start"], F.get(sections, i)["page_end"]),
    )
    before = F.filter(positions, lambda i: F.get(sections, i)["page_start"] <= page)
    return F.coalesce(F.get(inside, F.lit(0)), F.try_element_at(before, F.lit(-1)), last)


def attach_tables(sections: Column, tables: Column) -> Column:
    """Sections with their ``tables``, in table order; nothing is attached to no section."""

    def placed(secs: Column) -> Column:
        targets = F.transform(
            tables,
            lambda t: F.struct(
                section_for_page(secs, t["page"]).alias("target"),
                t["rows"].alias("rows"),
                t["page"].alias("page"),
            ),
        )

        def gather(ts: Column) -> Column:
            return F.transform(
                secs,
                lambda s, i: F.struct(
                    s["heading"].alias("heading"),
                    s["level"].alias("level"),
                    s["text"].alias("text"),
                    s["page_start"].alias("page_start"),
                    s["page_end"].alias("page_end"),
                    F.transform(
                        F.filter(ts, lambda t: t["target"] == i),
                        lambda t: F.struct(
                            s["heading"].alias("section_heading"),
                            t["rows"].alias("rows"),
                            t["page"].alias("page"),
                        ),
                    ).alias("tables"),
                ),
            )

        return F.when(F.size(secs) > 0, let(targets, gather))

    return let(sections, placed)


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def parse_structure(layout: DataFrame) -> DataFrame:
    """(document_id, name, items, raw_tables, …) rows to parsed documents.

    Adds ``title`` and ``sections`` (each with its ``tables``) and drops the layout arrays.
    """
    sections = attach_tables(sections_of(F.col("items")), tables_of(F.col("raw_tables")))
    return layout.select(
        *[c for c in layout.columns if c not in ("items", "raw_tables")],
        document_title(F.col("items"), F.col("name")).alias("title"),
        F.coalesce(sections, F.array()).alias("sections"),
    )


def explode_sections(parsed: DataFrame) -> DataFrame:
    """One row per section with its 0-based position."""
    rows = unnest(parsed, F.col("sections"), "document_id", pos="section_pos", item="section")
    return rows.select("document_id", "section_pos", "section.*")


def parse_summary(parsed: DataFrame) -> DataFrame:
    """Sections, tables, pages and text length of every document (row-local)."""
    pages = F.array_max(F.transform("sections", lambda s: s["page_end"]))
    return parsed.select(
        "document_id",
        F.size("sections").cast("bigint").alias("section_count"),
        F.aggregate(
            "sections", F.lit(0), lambda n, s: n + F.size(s["tables"])
        ).cast("bigint").alias("table_count"),
        pages.cast("bigint").alias("last_page"),
        F.aggregate(
            "sections", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s["text"])
        ).alias("text_length"),
    )
