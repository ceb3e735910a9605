"""Metadata sidecars in YAML: a Python data source over files, and the same reading for texts in a column.

A sidecar is a mapping of proposal fields, flat or nested under ``proposal`` next to chunk fields. What
cannot be read has null fields and a ``problem``: ``malformed``, ``not_a_mapping``, ``extra:<key>`` or
``type:<field>`` (the first in this order, keys in the order of their names).
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string

from folioflow.functions.ids import document_id, resolve_source_path
from folioflow.sources.documents import PROPOSAL_FIELDS

try:
    import yaml
except ImportError:  # only these readers need it
    yaml = None

FIELDS = [f.strip().split(" ")[0] for f in PROPOSAL_FIELDS.split(",")]
#: Files of one partition; sidecars are small.
FILES_PER_PARTITION = 2000
_NOTHING = (None,) * len(FIELDS)


def _value(name: str, value):
    """The value as its field's type; a ValueError if it is of another."""
    if value is None:
        return None
    if name == "year":
        if isinstance(value, bool) or not str(value).strip().lstrip("-").isdigit():
            raise ValueError(name)
        return int(value)
    if name == "ingested_at":
        if isinstance(value, str):
            value = datetime.datetime.fromisoformat(value)
        elif not isinstance(value, datetime.datetime):
            raise ValueError(name)
        return value if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
    if not isinstance(value, str):
        raise ValueError(name)
    return value


def parse_sidecar(text: str | None) -> tuple[tuple, str | None]:
    """(values of FIELDS, problem) of one sidecar."""
    if yaml is None:
        raise ModuleNotFoundError("reading YAML sidecars needs the yaml package")
    try:
        found = yaml.safe_load(text or "")
    except (yaml.YAMLError, ValueError):
        return _NOTHING, "malformed"
    if not isinstance(found, dict):
        return _NOTHING, "not_a_mapping"
    nested = found.get("proposal")
    record = nested if isinstance(nested, dict) else found
    for key in sorted(map(str, record)):
        if key not in FIELDS:
            return _NOTHING, f"extra:{key}"
    values = []
    for name in FIELDS:
        try:
            values.append(_value(name, record.get(name)))
        except ValueError:
            return _NOTHING, f"type:{name}"
    return tuple(values), None


def sidecar_rows(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep…, proposal fields…, problem) of sidecar texts in a column."""
    given = table.select(*keep, F.col(text).alias("__text"))
    schema = StructType(given.schema.fields[:-1] + _parse_datatype_string(f"{PROPOSAL_FIELDS}, problem string").fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*v, p) for v, p in map(parse_sidecar, batch.column("__text").to_pylist())]
            out = batch.drop_columns(["__text"])
            for name, values in zip([*FIELDS, "problem"], zip(*rows, strict=True) if rows else [()] * (len(FIELDS) + 1), strict=True):
                kind = {"year": pa.int32(), "ingested_at": pa.timestamp("us", "UTC")}.get(name, pa.string())
                out = out.append_column(name, pa.array(values, kind))
            yield out

    return given.mapInArrow(read, schema)


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class SidecarSource(DataSource):
    """``spark.read.format("sidecars").load(folder)``: one row a ``*.yaml`` or ``*.yml`` file below the folder."""

    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return f"sidecar string, {PROPOSAL_FIELDS}, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SidecarReader(self.options["path"])


class _SidecarReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Files]:
        """Groups of files; the driver sees their names only."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(i.path for i in found if i.is_file and PurePosixPath(i.path).suffix.lower() in (".yaml", ".yml"))
        return [_Files(names[at : at + FILES_PER_PARTITION]) for at in range(0, len(names), FILES_PER_PARTITION)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else f"file://{self.folder}")
        for name in partition.files:
            with store.open_input_stream(name) as source:
                raw = source.read()
            try:
                values, problem = parse_sidecar(raw.decode("utf-8"))
            except UnicodeDecodeError:
                values, problem = _NOTHING, "malformed"
            yield name, *values, problem


def read_sidecars(spark: SparkSession, folder: str, *, keep_problems: bool = False) -> DataFrame:
    """Proposals of all YAML sidecars below a folder, like ``documents.read_proposals`` of JSON ones.

    A relative ``source_path`` is resolved against its sidecar's folder and names the document. A file
    that cannot be read fails the job, or stays with its ``problem`` if asked.
    """
    spark.dataSource.register(SidecarSource)
    rows = spark.read.format("sidecars").load(folder)
    if keep_problems:
        checked = rows
    else:
        message = F.concat(F.lit("sidecar "), "sidecar", F.lit(": "), "problem")
        checked = rows.withColumn("sidecar", F.when(F.col("problem").isNull(), F.col("sidecar")).otherwise(F.raise_error(message))).drop("problem")
    return (
        checked.withColumn("source_path", resolve_source_path(F.col("source_path"), F.col("sidecar")))
        .withColumn("language", F.coalesce("language", F.lit("en")))
        .withColumn("document_id", document_id(F.col("source_path")))
    )
