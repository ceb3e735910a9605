"""Policy-ranked retrieval for a whole table of queries.

Order of work, per query: hard filters, over-fetched candidate pool by similarity, relaxed
pool when the section filter leaves nothing, thresholds, reviewer-note exclusion, priority
order, cap on rejected sources, final cut. The relaxed pool is computed in the same scan as
the strict one (each query goes in twice when it may fall back), so the chunk table is read
once whether or not any query falls back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow import vocab
from folioflow.functions.text import lookup
from folioflow.operators.embedding import hash_embedding
from folioflow.operators.similarity import top_n

FILTERS = ("programme", "section_type", "source_status")


@dataclass(frozen=True)
class RetrievalPolicy:
    relevance_threshold: float = 0.30
    lessons_learned_mode: bool = False
    rejected_threshold_offset: float = 0.0
    include_esr: bool = True
    funded_first: bool = True
    max_rejected_fraction: float = 0.4
    section_type_fallback: bool = True

    def __post_init__(self) -> None:
        if not 0.0 <= self.relevance_threshold <= 1.0:
            raise ValueError("relevance_threshold must lie in [0, 1]")
        if not -1.0 <= self.rejected_threshold_offset <= 1.0:
            raise ValueError("rejected_threshold_offset must lie in [-1, 1]")
        if not 0.0 <= self.max_rejected_fraction <= 1.0:
            raise ValueError("max_rejected_fraction must lie in [0, 1]")


def resolve_requests(requests: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """Per-request settings: a null override inherits the policy."""
    lessons = F.coalesce("lessons_learned", F.lit(policy.lessons_learned_mode))
    fallback = F.coalesce("section_type_fallback", F.lit(policy.section_type_fallback))
    return requests.select(
        "query_id",
        "query",
        "top_k",
        *FILTERS,
        lessons.alias("lessons"),
        (fallback & F.col("section_type").isNotNull() & F.col("source_status").isNull()).alias(
            "may_fall_back"
        ),
        F.least(F.lit(vocab.MAX_CANDIDATES), F.col("top_k") * vocab.OVER_FETCH).alias("n"),
    )


def candidate_pool(chunks: DataFrame, resolved: DataFrame) -> DataFrame:
    """Over-fetched candidates: (query_id, chunk_id, source_status, score, fell_back)."""
    embedded = resolved.select(
        "query_id", "n", *FILTERS, "may_fall_back", hash_embedding(F.col("query")).alias("embedding")
    )
    # variant = 2 * query_id for the strict pool, + 1 for the one without a section filter
    variants = embedded.withColumn(
        "relaxed",
        F.explode(
            F.when(F.col("may_fall_back"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ),
    ).select(
        (F.col("query_id") * 2 + F.col("relaxed")).alias("variant"),
        "n",
        "embedding",
        "programme",
        F.when(F.col("relaxed") == 0, F.col("section_type")).alias("section_type"),
        "source_status",
    )
    pool = top_n(
        chunks,
        variants,
        query_column="variant",
        n_column="n",
        filter_columns=FILTERS,
        carry=("source_status",),
    ).select(
        F.shiftright("variant", 1).alias("query_id"),
        F.pmod("variant", F.lit(2)).alias("relaxed"),
        "chunk_id",
        "source_status",
        "score",
    )
    per_query = Window.partitionBy("query_id")  # at most 2 x 100 rows each
    return (
        pool.withColumn("strictest", F.min("relaxed").over(per_query))
        .filter(F.col("relaxed") == F.col("strictest"))
        .select("query_id", "chunk_id", "source_status", "score", (F.col("relaxed") == 1).alias("fell_back"))
    )


def threshold(status: Column, lessons: Column, policy: RetrievalPolicy) -> Column:
    shifted = min(1.0, max(0.0, policy.relevance_threshold + policy.rejected_threshold_offset))
    return F.when(lessons & (status == "rejected"), F.lit(shifted)).otherwise(
        F.lit(policy.relevance_threshold)
    )


def policy_reason(status: Column, lessons: Column, fell_back: Column) -> Column:
    base = F.when((status == "rejected") & lessons, F.lit(vocab.REASON_LESSONS)).otherwise(
        lookup(status, vocab.REASON_BY_STATUS, F.lit(vocab.REASON_BY_STATUS["unknown"]))
    )
    return F.concat(
        base, F.when(fell_back, F.lit(vocab.REASON_FALLBACK_SUFFIX)).otherwise(F.lit(""))
    )


def rank_by_policy(scored: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """Scored candidates (query_id, top_k, lessons, chunk_id, source_status, score,
    fell_back) to ranked results. Every window holds one query's bounded pool."""
    status = F.col("source_status")
    kept = scored.filter(F.col("score") >= threshold(status, F.col("lessons"), policy))
    if not policy.include_esr:
        kept = kept.filter(status != "esr_note")
    priority = lookup(status, {k: str(v) for k, v in vocab.STATUS_PRIORITY.items()}).cast("int")
    keys = [priority, F.col("score").desc()]
    if not policy.funded_first:
        keys.reverse()
    order = Window.partitionBy("query_id").orderBy(*keys, "chunk_id")
    seen = F.sum((status == "rejected").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if policy.max_rejected_fraction < 1.0:
        # double arithmetic on purpose: 100 * 0.29 floors to 28
        cap = F.floor(F.col("top_k") * F.lit(float(policy.max_rejected_fraction)))
        kept = kept.withColumn("rejected_seen", seen).filter(
            F.col("lessons") | (status != "rejected") | (F.col("rejected_seen") <= cap)
        )
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("top_k"))
        .withColumn("policy_reason", policy_reason(status, F.col("lessons"), F.col("fell_back")))
        .drop("rejected_seen")
    )


def retrieve(
    chunks: DataFrame, requests: DataFrame, policy: RetrievalPolicy = RetrievalPolicy()
) -> DataFrame:
    """Ranked results: (query_id, rank, chunk_id, source_status, score, policy_reason).

    ``query_id`` is a whole number; filters and overrides of a request may be null.
    ``chunks`` needs chunk_id, the filter columns and ``embedding``. Requests with
    ``top_k < 1`` are refused by ``validation.request_errors`` beforehand.
    """
    resolved = resolve_requests(requests, policy)
    pool = candidate_pool(chunks, resolved)
    settings = resolved.select("query_id", "top_k", "lessons")
    return rank_by_policy(pool.join(settings, "query_id"), policy).select(
        "query_id", "rank", "chunk_id", "source_status", F.round("score", vocab.SCORE_DIGITS).alias("score"), "policy_reason"
    )
