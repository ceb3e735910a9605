"""WARC archives in Zstandard: one frame per record, and the dictionary in a leading skippable frame.

write_archives() gives every page one record. Of pages with equal payloads of at least
MIN_DUPLICATE bytes, the one with the smallest page_id is a response and the others revisit it; smaller
payloads are responses, always. Each task writes archives of at most about ARCHIVE_BYTES to a folder that
all nodes share, under a name of its own; only archives of tasks that succeeded are listed, so a task
that runs again leaves nothing wrong behind.

read_archives() reads any such archive: it takes the dictionary from the skippable frame, finds each
frame by its block headers, decodes one frame at a time, and checks the version line, the headers, the
record's length and the digest of its payload. A damaged archive raises an error that names the place.

Null html counts as empty. Repeated page_ids are records of their own; equal ones with the smallest id
are all responses. A page without an id has a record without one and is a response.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Scratch

MIN_DUPLICATE = 100
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many pages, and so many bytes of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 16 << 10, 64 << 10
#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that is not as the format says."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http_headers(self) -> dict[str, str]:
        return _headers(self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"no header: {line[:80]!r}")
        out[name.strip().decode().lower()] = value.strip().decode()
    return out


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """One record, its headers and length checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or first != VERSION:
        raise ArchiveError(f"no record: {data[:40]!r}")
    headers = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"{name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4:
        raise ArchiveError(f"{headers['content-length']} bytes are declared, {len(rest) - 4} are there")
    if not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError("a record has no end")
    return Record(headers, rest[:-4])


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins here, from its header and block headers."""
    if bytes(data[at : at + 4]) != FRAME_MAGIC:
        raise ArchiveError(f"no frame at byte {at}")
    place = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if place + 3 > len(data):
            raise ArchiveError(f"the frame at byte {at} is cut off")
        header = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = header & 1, header >> 1 & 3, header >> 3
        place += 3 + (1 if kind == 1 else size)
        if last:
            break
    place += 4 * (data[at + 4] >> 2 & 1)  # checksum
    if place > len(data):
        raise ArchiveError(f"the frame at byte {at} is cut off")
    return place - at


def archive_start(dictionary: bytes) -> bytes:
    """The skippable frame that holds the dictionary; nothing for none."""
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def read_records(data: bytes) -> Iterator[Record]:
    """The records of an archive, one frame at a time."""
    view, at, dictionary = memoryview(data), 0, b""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        at = 8 + size
        if at > len(data):
            raise ArchiveError("the dictionary is cut off")
        dictionary = data[8:at]
        if dictionary.startswith(FRAME_MAGIC):  # the dictionary may be compressed itself
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decoder = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(data):
        size = frame_length(view, at)
        try:
            record = decoder.decompressobj().decompress(bytes(view[at : at + size]))
        except zstandard.ZstdError as error:
            raise ArchiveError(f"the frame at byte {at} cannot be decoded") from error
        yield parse_record(record)
        at += size


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; none if they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def page_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A page as a response with its payload, or as a revisit with the same HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    return record_bytes(headers, http.encode() + (b"" if revisit else payload))


def _planned(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and the page they revisit."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    known = known.withColumn("digest", F.sha2("payload", 256))
    # only digests meet; their groups are counted before the shuffle
    firsts = (
        known.where((F.length("payload") >= MIN_DUPLICATE) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
        .where("pages > 1")
        .select("digest", "first")
    )
    first = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return known.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", first.alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, records, bytes) of the archives that hold all pages."""
    columns = pages.select(F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    sample = columns.where(F.length("payload") > 0).select(F.substring("payload", 1, SAMPLE_BYTES)).limit(SAMPLE_PAGES)
    dictionary = train_dictionary([bytes(r[0]) for r in sample.collect()])
    folder = f"{scratch.folder}/warc"

    def write(batches):
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        start = archive_start(dictionary)
        frames, size, written = [], 0, []

        def close():
            store, path = pafs.FileSystem.from_uri(folder)
            name = f"{uuid.uuid4().hex}.warc.zst"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(start + b"".join(frames))
            written.append((f"{folder}/{name}", len(frames), size + len(start)))

        for batch in batches:
            names = ("page_id", "url", "payload", "digest", "refers_to")
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                frames.append(encoder.compress(page_record(*row)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    close()
                    frames, size = [], 0
        if frames:
            close()
        paths, records, sizes = zip(*written, strict=True) if written else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"],
        )

    # written down, so that reading does not write again
    return scratch.save(_planned(pages).mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


#: Bytes of archives that one task reads, about, where there are more than tasks anyway.
TASK_BYTES = 128 << 20
_FIELDS = [
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
]


def _described(record: Record) -> tuple:
    headers = record.headers
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    declared = int(record.http_headers.get("content-length", "0"))
    if headers["warc-type"] == "response":
        payload = record.payload
        if len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest:
            raise ArchiveError(f"the payload of {headers['warc-record-id']} is not what its headers say")
    page, first = headers.get("x-page-id", ""), headers.get("x-refers-to-page-id", "")
    return int(page) if page else None, declared, digest, headers["warc-type"], int(first) if first else None


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives."""

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as source:
                    rows = [_described(r) for r in read_records(source.read())]
                columns = zip(*rows, strict=True) if rows else [[]] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)],
                    names=[n for n, _ in _FIELDS],
                )

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    count, size = archives.agg(F.count("*"), F.sum("bytes")).first()
    # a number, or the few bytes of the paths would be packed into one task
    least = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(count, max(least, (size or 0) // TASK_BYTES)))
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, Scratch(spark)))


OP7_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest,
    min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_DUPLICATE} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_DUPLICATE} AND page_id > first THEN first END AS refers_to
FROM d
"""
