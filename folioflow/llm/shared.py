"""Helpers that several operators share: tables in the shared folder, and word fingerprints."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass handles at a time; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: The same where each byte takes many numbers at once.
PASS_BYTES = 1 << 18
#: The six ASCII white-space characters that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all nodes see.

    Only a single-JVM session (tests) may leave it unset; it then gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="spark-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one run in the shared folder: written once, read back with short lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def save(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        table.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or the whole run's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Shuffle files of finished steps go when the driver's references to them are collected."""
        self.spark._jvm.System.gc()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_chunks(batches, name: str = "text", rows: int = 1 << 20, size: int = CHUNK_BYTES):
    """Arrow batches cut into pieces of about `size` bytes of text (a longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(name))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: a bijection that spreads every input bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_FACTOR, _INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _byte_codes() -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    codes[ord("A") : ord("Z") + 1] += np.uint64(32)  # A-Z count as a-z
    return mix(codes + np.uint64(0x51ED270B))


_CODES = _byte_codes()
_IS_SPACE = np.isin(np.arange(256), SPACES)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and how many words each row has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(column: pa.Array, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words of a column, A-Z lower-cased, and each row's number of words.

    `fold` gives the byte that each byte counts as; without it every byte counts as itself.
    """
    data, offsets = column_bytes(column)
    data = data if fold is None else fold[data]
    starts, ends, counts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = 1 << max(16, int(len(data)).bit_length())
    # a worker lives on: what only one long text needs does not stay with it
    power, inverse = _powers(size) if size <= 2 * CHUNK_BYTES else _powers.__wrapped__(size)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[data] * power[: len(data)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return mix(hashes ^ (ends - starts).astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's k-word shingles, in order, and each row's number of them.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    row = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    for j in range(k):
        part = padded[j : j + len(words)] * factors[j]
        if j:
            same = np.zeros(len(words), bool)
            same[: len(words) - j] = row[j:] == row[: len(words) - j]
            part[~same] = 0
        sums += part
    begin = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(begin, counts)
    keep = (place + k <= np.repeat(counts, counts)) | (place == 0)
    sums = mix(sums ^ np.minimum(np.repeat(counts, counts), k).astype(np.uint64))
    per_row = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    return sums[keep], per_row
