"""Text to vectors.

The hash embedding runs as an Arrow UDF next to the text it reads: no token is shuffled, and since
words repeat, each Python worker hashes a common word once and then only looks it up. Any other
model plugs in through ``model_embedding``. Of an Arrow batch, whatever its length, only a few texts
at a time become Python objects; beside the batch a worker holds the vectors it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from folioflow import vocab

_KNOWN_TOKENS = 200_000  # words remembered per Python worker
_TEXTS = 64  # texts of a batch that are Python objects at once


def _token_buckets(dim: int) -> Callable[[str], int]:
    from functools import lru_cache
    from hashlib import sha256

    @lru_cache(maxsize=_KNOWN_TOKENS)
    def bucket(token: str) -> int:
        return int.from_bytes(sha256(token.encode("utf-8")).digest()[:8], "big") % dim

    return bucket


def _vectors(texts: pa.Array, dim: int, size: int, embed: Callable[[list[str]], np.ndarray]) -> pa.Array:
    """Vectors of the texts that are not null, ``size`` texts at a time; null for the others."""
    lacking = texts.is_null().to_numpy(zero_copy_only=False)
    given = texts.drop_null()
    flat = np.empty((len(given), dim), dtype=np.float32)
    for at in range(0, len(given), size):
        flat[at : at + size] = embed(given.slice(at, size).to_pylist())
    stops = np.cumsum(~lacking, dtype=np.int64) * dim
    if len(stops) and stops[-1] >= 1 << 31:
        raise ValueError("a batch of vectors needs fewer than 2^31 components; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, flat.ravel(), mask=pa.array(lacking))


def _hashed(bucket: Callable[[str], int], dim: int) -> Callable[[list[str]], np.ndarray]:
    def embed(texts: list[str]) -> np.ndarray:
        hits = [np.asarray([bucket(t) for t in text.lower().split()], dtype=np.int64) + i * dim for i, text in enumerate(texts)]
        counts = np.bincount(np.concatenate(hits), minlength=len(texts) * dim).reshape(-1, dim)
        norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        norms[norms == 0] = 1.0
        return counts / norms[:, None]

    return embed


def hash_embedding(text: Column, dim: int = vocab.HASH_EMBEDDING_DIM) -> Column:
    """L2-normalised token counts over ``dim`` hash buckets; no token gives a zero vector."""
    if dim <= 0:
        raise ValueError(f"dim must be positive, got {dim}")

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _hashed(_token_buckets(dim), dim)
        for texts in batches:
            yield _vectors(texts, dim, _TEXTS, model)

    return embed(text)


def _checked(model: Callable[[list[str]], list], dim: int) -> Callable[[list[str]], np.ndarray]:
    def embed(texts: list[str]) -> np.ndarray:
        vectors = model(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"model gave {len(vectors)} vectors for {len(texts)} texts")
        for v in vectors:
            if len(v) != dim:
                raise ValueError(f"model gave width {len(v)}, expected {dim}")
        return np.asarray(vectors, dtype=np.float32)

    return embed


def model_embedding(
    text: Column, load_model: Callable[[], Callable[[list[str]], list]], dim: int, batch: int = 64
) -> Column:
    """Vectors from any model: ``load_model`` runs once per Python worker, then texts go
    through in batches. Null texts are skipped. A wrong count or width fails the job
    instead of storing bad rows."""

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _checked(load_model(), dim)
        for texts in batches:
            yield _vectors(texts, dim, batch, model)

    return embed(text)


def embed_missing(chunks: DataFrame, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """Fill ``embedding`` where it is null and keep every vector that was supplied.

    One pass: rows that already have a vector hand a null text to the model, which skips it.
    """
    lacking = F.when(F.col("embedding").isNull(), F.col("text"))
    return chunks.withColumn("embedding", F.coalesce("embedding", embed(lacking)))


def split_by_width(chunks: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by declared vector width."""
    good = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return chunks.filter(good), chunks.filter(~good)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vector columns in double precision; zero vectors score 0."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
