"""Identity rules: document ids, chunk ids, content hashes, archive names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import empty_to_null


def document_id(path: Column) -> Column:
    """File name without its last extension; the whole path when there is no name."""
    name = F.regexp_extract(path, r"([^/]+)/*\z", 1)
    stem = F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")
    stem = F.when(stem == ".", F.lit("")).otherwise(stem)
    return F.coalesce(empty_to_null(stem), path)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def chunk_id(document: Column, heading: Column, index: Column) -> Column:
    """``document::first 12 hex digits of sha256(heading)::six-digit index``."""
    anchor = F.coalesce(empty_to_null(heading), F.lit(vocab.NO_SECTION))
    return F.concat_ws(
        "::", document, F.substring(F.sha2(anchor, 256), 1, 12), F.format_string("%06d", index)
    )


def document_of_chunk(chunk: Column) -> Column:
    """The document id in a chunk id: all but its last two parts; null if it has only these."""
    form = r"(?s)\A(.*)::[0-9a-f]{12}::[0-9]+\z"
    return F.when(F.rlike(chunk, F.lit(form)), F.regexp_extract(chunk, form, 1))


def archive_name(
    programme: Column, call: Column, topic: Column, file_name: Column, token: Column | None = None
) -> Column:
    """``programme-call-topic-file`` with the staging token dropped and slashes flattened."""
    name = file_name
    if token is not None:
        prefix = F.concat(token, F.lit("__"))
        name = F.when(
            F.startswith(file_name, prefix), F.substr(file_name, F.length(prefix) + 1)
        ).otherwise(file_name)
    topic = F.coalesce(empty_to_null(topic), F.lit("whole-call"))
    return F.translate(F.concat_ws("-", programme, call, topic, name), "/\\", "__")


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def resolve_source_path(source_path: Column, sidecar_path: Column) -> Column:
    """A relative source path is resolved against the folder of its metadata file."""
    folder = F.regexp_replace(sidecar_path, r"/[^/]*\z", "")
    return F.when(source_path.startswith("/"), source_path).otherwise(
        F.concat(folder, F.lit("/"), source_path)
    )
