"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one, two and three characters of the lower-cased text are hashed into DIMENSIONS cells; a
text's vector is log(1 + count) times the cell's inverse document frequency, at unit length.
Document frequencies cover all training documents. The weights are learnt by follow-the-regularised-
leader with an elastic net, on a sample of about SAMPLE documents of each language (chosen by a hash
of the id); a fifth of the sample is set aside to fit the temperature of the softmax.

Training documents are those with a language and crc32(doc_id) mod 5 <> 0. A text that is null or has
no letter is `und` with score 0; so is everything if there is no training document. Rows are
predicted one by one: repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.quality import held_out
from folioflow.llm.shared import mix, text_chunks
from folioflow.llm.sketch import filled

DIMENSIONS = 1 << 13
ORDERS = 3
#: Documents of each language that the weights are learnt from, about.
SAMPLE = 600
#: Rows of one dense block of counts (16 MB).
ROWS = 512
#: The follow-the-regularised-leader settings.
ALPHA, BETA, LASSO, RIDGE, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3


def gram_counts(texts: list[str]) -> np.ndarray:
    """A row of n-gram counts per text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        gram = codes
        for order in range(ORDERS):
            if order:
                gram = gram[:-1] * np.uint64(0x100000001B3) + codes[order:] + np.uint64(order)
            cells = (mix(gram) >> np.uint64(40)) % np.uint64(DIMENSIONS)
            out[row] += np.bincount(cells.astype(np.int64), minlength=DIMENSIONS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # dimensions x languages
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(weighted(gram_counts(texts), self.idf) @ self.weights / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(cells: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, kinds: int) -> np.ndarray:
    """Weights (dimensions x kinds) by FTRL-Proximal, one example at a time."""
    z, n = np.zeros((DIMENSIONS, kinds)), np.zeros((DIMENSIONS, kinds))

    def weights(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - LASSO, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + RIDGE)

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(labels)):
            at, x = cells[i], values[i]
            w = weights(z[at], n[at])
            p = softmax((x @ w)[None, :])[0]
            p[labels[i]] -= 1
            g = x[:, None] * p
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    return weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on what was set aside."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    losses = [
        -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid
    ]
    return float(grid[int(np.argmin(losses))])


def fit_languages(documents: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """The model of documents (doc_id, text, lang); None without training documents."""
    training = documents.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)

    def add_documents(batches, totals):
        for piece in text_chunks(batches, rows=ROWS):
            counts = gram_counts(piece.column("text").to_pylist())
            totals += (counts > 0).sum(axis=0).astype(np.uint32)

    frequency = filled(training.select("text"), add_documents, DIMENSIONS, np.uint32, np.add)
    idf = np.log((1 + sum(sizes.values())) / (1.0 + frequency)).astype(np.float32) + 1

    def vectors(batches):
        for piece in text_chunks(batches, rows=ROWS):
            x = weighted(gram_counts(piece.column("text").to_pylist()), idf)
            cells = [np.flatnonzero(row).astype(np.uint16) for row in x]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("lang"), piece.column("mark"),
                    pa.array([c.tobytes() for c in cells], pa.binary()),
                    pa.array([row[c].astype(np.float32).tobytes() for row, c in zip(x, cells, strict=True)], pa.binary()),
                ],
                names=["lang", "mark", "cells", "values"],
            )

    share = F.lit(None).cast("double")
    for name in languages:
        share = F.when(F.col("lang") == name, sample / sizes[name]).otherwise(share)
    mark = F.xxhash64("doc_id")
    chosen = training.select("lang", "text", mark.alias("mark")).where(
        F.pmod(F.col("mark"), F.lit(1_000_000)) < share * 1_000_000
    )
    rows = chosen.mapInArrow(vectors, "lang string, mark bigint, cells binary, values binary").toPandas()
    rows = rows.sort_values(["mark", "lang", "cells", "values"], kind="stable")
    cells = [np.frombuffer(c, np.uint16).astype(np.int64) for c in rows["cells"]]
    values = [np.frombuffer(v, np.float32).astype(float) for v in rows["values"]]
    labels = np.array([languages.index(name) for name in rows["lang"]], np.int64)
    aside = np.arange(len(labels)) % 5 == 4
    learn = np.flatnonzero(~aside)
    weights = ftrl([cells[i] for i in learn], [values[i] for i in learn], labels[learn], len(languages))
    logits = np.array([values[i] @ weights[cells[i]] for i in np.flatnonzero(aside)]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), _temperature(logits, labels[aside]))


def predicted_languages(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    table = documents.select(F.col("doc_id").cast("bigint"), "text", readable.alias("readable"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def predict(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for piece in text_chunks(batches, rows=ROWS):
            p = model.probabilities([t or "" for t in piece.column("text").to_pylist()])
            best = p.argmax(axis=1)
            score = p[np.arange(len(p)), best].astype(float)
            unread = ~piece.column("readable").to_numpy(zero_copy_only=False)
            best[unread], score[unread] = len(model.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                names=["doc_id", "lang_pred", "score"],
            )

    return table.mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predicted = predicted_languages(documents, fit_languages(documents))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
