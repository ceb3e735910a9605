"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A walk reads a text from left to right. At every time step it writes down the character it stands on,
and a random bit, shared by all texts, for this time and this character says whether it moves on. Two
texts of a small edit distance fall into step again after each edit, so what they write differs in few
places: edit distance becomes Hamming distance. The bits repeat after PERIOD steps, so a walk is a table
of states: a state and a character give the next state, and no step is made that does not move.

A fingerprint samples each walk at SAMPLES places, as one byte for the GRAM characters written from
there on. The place is that of the least of fixed random numbers among all the walk's steps. It is
uniform over the walk, and the same for two walks of different length unless the longer one's rest holds
it, so texts that share their beginnings share places as well. Likeness is the share of equal bytes: about
the part of the longer walk that both texts walk in step.

`fingerprints` needs no shuffle. `edited_fingerprints` brings every document to the next one in
descending doc_id by one shuffle of the texts into ranges; only the rows where a range begins are sent
twice. `near_documents` finds partners of the query rows by equal bands of sampled bytes and verifies them.

Defined cases: a null text is empty; an empty text has a fingerprint of its own; texts of any length are
walked whole; a null doc_id comes last; rows of one doc_id follow their texts, rows that are equal
altogether stand side by side; a single row is its own next one; empty tables give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Scratch, mix, text_chunks

WALKS = 2
SAMPLES = 64
GRAM = 8
#: A time within the period is one byte.
PERIOD = 256
CLASSES = 64
#: Sampled bytes of a band; 32 bands find a likeness of 0.5 with a chance of 0.87, of 0.67 with 0.999.
BAND_BYTES = 4
LIKENESS = 0.5
_LONGEST = 1 << 50


def _numbers(seed: int, count: int) -> np.ndarray:
    """Fixed random 64-bit numbers."""
    return mix(mix(np.arange(count, dtype=np.uint64)) + np.uint64(0x9E3779B9 * (seed + 1)))


class Walk:
    """States of one walk over the character classes, and the places its fingerprint samples."""

    def __init__(self, seed: int):
        bits = (_numbers(2 * seed, CLASSES * PERIOD) >> np.uint64(40)).astype(np.uint8).reshape(CLASSES, PERIOD) & 1
        at = np.where(np.tile(bits, 2) == 1, np.arange(2 * PERIOD), 4 * PERIOD)
        leave = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        following = ((leave + 1) % PERIOD).T.tolist()
        self.states = [[] for _ in range(PERIOD)]
        for time, state in enumerate(self.states):
            state.extend(self.states[t] for t in following[time])
            state.append(time)
        self.records = self._records(seed)
        keys = _numbers(4 * seed + 3, SAMPLES * GRAM).reshape(SAMPLES, GRAM) | np.uint64(1)
        self.keys = keys

    @staticmethod
    def _records(seed: int) -> np.ndarray:
        """For each sample the steps at which the least random number so far appears, in order."""
        rows = []
        for draws in _numbers(4 * seed + 1, SAMPLES * 256).reshape(SAMPLES, 256):
            row = [0]
            for draw in draws.tolist():
                if row[-1] >= _LONGEST:
                    break
                row.append(int((row[-1] + 1) / ((draw >> 11) + 1) * 2.0**53))
            rows.append(row)
        out = np.full((SAMPLES, max(map(len, rows))), 1 << 62, np.int64)
        for place, row in enumerate(rows):
            out[place, : len(row)] = row
        return out

    def times(self, classes: bytes, start: int = 0) -> np.ndarray:
        """Time, modulo PERIOD, at which the walk comes to each character and to the end."""
        states = itertools.accumulate(classes, operator.getitem, initial=self.states[start])
        return np.frombuffer(bytes(map(operator.itemgetter(CLASSES), states)), np.uint8)

    def sample(self, times: np.ndarray, points: np.ndarray) -> np.ndarray:
        """SAMPLES bytes of a walk over these code points and a final 0; `times` are modulo PERIOD."""
        arrival = np.zeros(len(times), np.int64)
        np.cumsum(times[1:] - times[:-1], out=arrival[1:])  # bytes wrap around as the period does
        last = np.maximum((self.records < arrival[-1]).sum(axis=1) - 1, 0)
        steps = self.records[np.arange(SAMPLES), last][:, None] + np.arange(GRAM)
        place = arrival.searchsorted(steps, side="right") - 1  # the final 0 beyond the end
        written = points[place].astype(np.uint64) + np.uint64(1)
        return (mix((written * self.keys).sum(axis=1) + steps[:, 0].astype(np.uint64)) >> np.uint64(24)).astype(np.uint8)


@functools.lru_cache(maxsize=1)
def walks() -> tuple[Walk, ...]:
    return tuple(Walk(seed) for seed in range(WALKS))


def code_points(text: str) -> tuple[np.ndarray, bytes]:
    """Code points of a text and a final 0, and the class of each."""
    points = np.frombuffer((text + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, (((points[:-1] * np.uint32(2654435761)) >> np.uint32(11)) & np.uint32(CLASSES - 1)).astype(np.uint8).tobytes()


class Walked:
    """A text with its walks."""

    def __init__(self, text: str):
        self.text = text
        self.points, self.classes = code_points(text)
        self.times = [walk.times(self.classes) for walk in walks()]
        self.fingerprint = self._sampled(self.times, self.points)

    @staticmethod
    def _sampled(times: list, points: np.ndarray) -> bytes:
        return b"".join(w.sample(t, points).tobytes() for w, t in zip(walks(), times, strict=True))

    def edited(self, following: str) -> tuple[str, bytes]:
        """The text whose last third is replaced by the beginning of another one, and its fingerprint."""
        new = following[: len(self.text) // 3]
        stays = len(self.text) - len(self.text) // 3
        points, classes = code_points(new)
        times = [
            np.concatenate([old[:stays], walk.times(classes, int(old[stays]))])
            for walk, old in zip(walks(), self.times, strict=True)
        ]
        return self.text[:stays] + new, self._sampled(times, np.concatenate([self.points[:stays], points]))


def fingerprint(text: str | None) -> bytes:
    return Walked(text or "").fingerprint


def likeness(one: bytes, two: bytes) -> float:
    """Share of equal bytes of two fingerprints."""
    same = np.frombuffer(one, np.uint8) == np.frombuffer(two, np.uint8)
    return float(same.mean())


def shared_bands(one: bytes, two: bytes) -> int:
    """Number of bands in which two fingerprints agree, that is how often they meet as candidates."""
    same = np.frombuffer(one, np.uint8) == np.frombuffer(two, np.uint8)
    return int(same.reshape(-1, BAND_BYTES).all(axis=1).sum())


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document, as lower-case hex."""

    def make(batches):
        for batch in text_chunks(batches):
            made = [fingerprint(t).hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    table = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return table.mapInArrow(make, "doc_id bigint, fingerprint string")


def _in_ranges(documents: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): ranges in descending doc_id, each followed by the next one's first row.

    The ranges begin at ids that the table holds, as many as there are shuffle partitions; these ids
    are all that the driver sees. The last range is followed by the first row of all.
    """
    table = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    found, top = table.agg(
        F.percentile_approx("doc_id", cuts, max(10000, 100 * parts)).alias("bounds"), F.max("doc_id").alias("top")
    ).first()
    bounds = sorted({b for b in found or [] if b != top}, reverse=True)
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(held, lambda b: b >= F.col("doc_id"))))
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))
    before = F.struct((bucket - 1).alias("bucket"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("guest"))
    places = F.filter(
        F.array(
            own,
            F.when(F.array_contains(held, F.col("doc_id")), before),
            F.when(F.col("doc_id") == F.lit(top).cast("bigint"), around),
        ),
        lambda p: p.isNotNull(),
    )
    spread = table.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.guest", "doc_id", "text")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")


def _neighbours(batches):
    """(doc_id, walked text, walked text of the next row) for every row that is no guest."""

    def rows():
        for batch in text_chunks(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True)

    for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
        first, before, seen = None, None, None
        for _, guest, doc_id, text in group:
            if guest and before is None:
                break  # further guests
            if seen is None or text != seen.text:
                seen = Walked(text)
            first = first or seen
            if before is not None:
                yield *before, seen
            before = None if guest else (doc_id, seen)
        if before is not None:  # the only range, without ids
            yield *before, first


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has the last third of its characters replaced by the first as many of the next
    document's in descending doc_id. (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, bands_edited)
    """
    fields = (
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("bands_edited", pa.int64()),
    )

    def results(batches):
        for doc_id, own, following in _neighbours(batches):
            text, edited = own.edited(following.text)
            print_ = own.fingerprint
            yield (
                doc_id, len(own.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), print_.hex(),
                edited.hex(), likeness(print_, edited), likeness(print_, following.fingerprint), shared_bands(print_, edited),
            )

    def make(batches):
        found = results(batches)
        while some := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(zip(*some, strict=True), fields, strict=True)],
                names=[n for n, _ in fields],
            )

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, bands_edited bigint"
    )
    return _in_ranges(documents).mapInArrow(make, schema)


def _likeness(one: Column, two: Column) -> Column:
    size = WALKS * SAMPLES
    same = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substr(one, 2 * i + 1, F.lit(2)) == F.substr(two, 2 * i + 1, F.lit(2)))
    return F.size(same) / F.lit(float(size))


def fingerprint_classes(documents: DataFrame) -> DataFrame:
    """(fingerprint, class_id): the smallest doc_id of each fingerprint; rows without an id are left out."""
    made = fingerprints(documents.where("doc_id IS NOT NULL"))
    return made.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))


def near_documents(queries: DataFrame, documents: DataFrame, scratch: Scratch, least: float = LIKENESS) -> DataFrame:
    """(query_id, class_id, likeness): the classes of documents that each class of queries is like.

    Documents of one fingerprint are one class (see `fingerprint_classes`), queries likewise, so copies
    are compared once. A pair is a candidate if a band of both fingerprints agrees, and is returned if
    its likeness is at least `least`; a query's own class is among its answers.
    """

    def banded(table: DataFrame, name: str) -> DataFrame:
        numbers = F.sequence(F.lit(0), F.lit(WALKS * SAMPLES // BAND_BYTES - 1))
        bands = F.transform(
            numbers, lambda b: F.concat_ws(":", b, F.substr("fingerprint", 2 * BAND_BYTES * b + 1, F.lit(2 * BAND_BYTES)))
        )
        return table.select(name, F.explode(bands).alias("band"))

    asked = scratch.save(fingerprint_classes(queries).withColumnRenamed("class_id", "query_id"), "asked")
    held = scratch.save(fingerprint_classes(documents), "held")
    pairs = banded(held, "class_id").join(banded(asked, "query_id"), "band").select("query_id", "class_id").distinct()
    near = _likeness(F.col("fingerprint"), F.col("query_fingerprint"))
    return (
        pairs.join(asked.withColumnRenamed("fingerprint", "query_fingerprint"), "query_id").join(held, "class_id")
        .select("query_id", "class_id", near.alias("likeness")).where(F.col("likeness") >= least)
    )


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
