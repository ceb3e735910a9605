"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text gives a fixed vector of statistics (lengths, shares of kinds of bytes, repetition), put on
log scales. Both classes are Gaussian with shrinkage covariances: a class covariance is drawn towards
the pooled one and that towards its diagonal. A score is the logistic of the difference of log
densities and log priors; Mahalanobis distances use inverse Cholesky factors computed once.

Fitting adds up counts, sums and products per class in the tasks; all labelled rows count, so no
bound is needed. Labels are learnt only from documents with crc32(doc_id) mod 5 <> 0. Null texts
count as empty ones, which are scored like any other text. Labels that are null or whose document is
missing are ignored; repeated (document, label) rows count once. With fewer than two rows in a class
every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import PASS_BYTES, column_bytes, text_chunks, word_hashes, word_spans

THRESHOLD = 0.3
#: Weight of the pooled covariance in a class covariance, and of the diagonal in the pooled one.
TO_POOLED = 0.1
TO_DIAGONAL = 0.05

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _MARK, _SIGN, _WIDE, _LINE = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SIGN, np.int8)
    kinds[128:] = _WIDE
    kinds[:33] = _SPACE
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER)):
        kinds[list(chars)] = kind
    kinds[list(b"0123456789")] = _DIGIT
    kinds[list(b".,;:'\"?-()")] = _STOP
    kinds[list(b"!")] = _MARK
    kinds[ord("\n")] = _LINE
    return kinds


_KINDS = _kinds()
_USUAL = ((_UPPER, 0.02), (_DIGIT, 0.002), (_STOP, 0.03), (_MARK, 0.002), (_SIGN, 0.002), (_WIDE, 0.03))
FEATURES = (
    "bytes", "words", "lines", "word_bytes", "longest_word", "line_words", "upper", "digit", "stop",
    "mark", "sign", "wide", "distinct_words", "capital_words",
)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offsets = column_bytes(column)
    rows = len(column)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    kinds = np.bincount(row * 9 + _KINDS[data], minlength=rows * 9).reshape(rows, 9).astype(float)
    starts, ends, counts = word_spans(data, offsets)
    word_row = np.repeat(np.arange(rows), counts)
    longest = np.zeros(rows)
    np.maximum.at(longest, word_row, (ends - starts).astype(float))
    capital = np.bincount(word_row, weights=_KINDS[data[starts]] == _UPPER, minlength=rows)
    hashes, _ = word_hashes(column)
    order = np.lexsort((hashes, word_row))
    first = np.ones(len(order), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order], weights=first, minlength=rows)

    filled = (sizes - kinds[:, _SPACE] - kinds[:, _LINE]).astype(float)
    lines = kinds[:, _LINE] + 1

    def share(part, whole, usual, weight):
        """A logarithm of a share, drawn towards a usual value in short texts."""
        return np.log((part + weight * usual) / (whole + weight))

    byte_shares = [share(kinds[:, kind], filled, usual, 100) for kind, usual in _USUAL]
    return np.column_stack(
        [
            np.log1p(sizes), np.log1p(counts), np.log(lines), share(filled, counts, 5, 10), np.log(longest + 10),
            share(counts, lines, 20, 2), *byte_shares, share(distinct, counts, 1, 30), share(capital, counts, 0.1, 10),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Per class the mean, the inverse Cholesky factor and the constant; or only a share of label 1."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        logs = [
            c - 0.5 * np.square((x - m) @ f.T).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From each class's count, sum of vectors and sum of outer products."""
    total = counts.sum()
    if counts.min() < 2:
        return Discriminant(float(counts[1] / total) if total else 0.5)
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(total - 2, 1)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
    factors, constants = [], []
    for c in range(2):
        own = (1 - TO_POOLED) * scatter[c] / (counts[c] - 1) + TO_POOLED * pooled
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(counts[c] / total) - np.log(np.diag(lower)).sum())
    return Discriminant(float(counts[1] / total), means, np.array(factors), np.array(constants))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of the labelled documents (doc_id, text) that are not held out."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    known = known.where(~held_out(F.col("doc_id")))
    size = len(FEATURES)

    def describe(batches):
        for piece in text_chunks(batches, size=PASS_BYTES):
            values = statistics(piece.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), size).cast(pa.list_(pa.float64())),
                ],
                names=["doc_id", "x"],
            )

    def add_up(batches):
        counts, sums, products = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, size)
            quality = batch.column("quality").to_numpy(zero_copy_only=False)
            for c in range(2):
                own = x[quality == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0)
                products[c] += own.T @ own
        values = np.concatenate([counts, sums.ravel(), products.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"]
        )

    vectors = documents.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    vectors = vectors.select("doc_id", "text").mapInArrow(describe, "doc_id bigint, x array<double>")
    sums = vectors.join(known, "doc_id").mapInArrow(add_up, "cell int, value double")
    rows = sums.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # 2 + 2 d + 2 d^2 rows
    values = np.zeros(2 + 2 * size + 2 * size * size)
    for row in rows:
        values[row["cell"]] = row["value"]
    return fit(values[:2], values[2 : 2 + 2 * size].reshape(2, size), values[2 + 2 * size :].reshape(2, size, size))


def scored(documents: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for every row."""

    def score(batches):
        for piece in text_chunks(batches, size=PASS_BYTES):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(model.scores(statistics(piece.column("text"))))],
                names=["doc_id", "score"],
            )

    table = documents.select(F.col("doc_id").cast("bigint"), "text")
    return table.mapInArrow(score, "doc_id bigint, score double")


def accepted_documents(
    documents: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows, with all their columns, whose text scores at least the threshold."""
    model = fit_quality(labelled, labels)

    def keep(batches):
        for piece in text_chunks(batches, size=PASS_BYTES):
            passed = model.scores(statistics(piece.column("text"))) >= threshold
            yield piece.filter(pa.array(passed))

    return documents.mapInArrow(keep, documents.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
