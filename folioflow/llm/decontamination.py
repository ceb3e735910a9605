"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become words (lower-cased runs of letters and digits). A spaced seed is a mask that hashes
some word positions of a short window and ignores the others, so a substituted word under an
ignored position does not hide a match. Seed hashes of the benchmark meet those of every position
of every document; each hit is verified around its alignment.

A document overlaps an item if, along one alignment, some window of `window` words (the whole item,
if it is shorter) agrees in at least `percent` of its words. The three masks are lossless for the
defaults: whichever three of 16 words differ, one mask still finds an unbroken place (tested). Each
mask is placed wherever its own words fit. An item shorter than the window is cut into one block more
than words may differ, so one block agrees whole; its masks take the first words of each block, three if
all blocks have as many, else two or one. So documents are probed by at most three more masks, and only
by those that some item needs, however many lengths the items have (lossless for every window and percent).

Items are cut into overlapping parts of at most PART words, so that every window lies in one, and the
parts are broadcast in blocks of about BLOCK_SEEDS seeds; a larger benchmark takes more passes over
the documents. Nothing but verified hits is shuffled. Null and empty texts overlap nothing; items
of every length are compared, down to one word, which every document with that word holds; equal
items count once, under the smallest item_id. Rows with a null doc_id or item_id are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.rows import unnest
from folioflow.llm.shared import Scratch

MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 5, 9), (0, 1, 2, 6, 8, 9))
WINDOW = 16
PERCENT = 80
PART = 1024
#: About 60 bytes each on an executor, and 3 bytes of the parts' words.
BLOCK_SEEDS = 200_000
#: Words that a mask of a short item takes at most.
SHORT = 3


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def word_codes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def short_blocks(size: int, percent: int) -> tuple[int, list[int]]:
    """(words to take, where to take them) of a whole item of `size` words: one place agrees whole."""
    blocks = min(size * (100 - percent) // 100, size - 1) + 1
    return min(SHORT, size // blocks), [size * i // blocks for i in range(blocks)]


def _seed(number: int, mask: tuple[int, ...], at: Column) -> Column:
    return F.xxhash64(F.lit(number), *[F.col("w")[at + o] for o in mask])


def probes(table: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """One row (keep..., w, pos, mask, seed) for every mask and every place of the coded words where it fits."""
    spans = F.array(*[F.lit(m[-1] + 1) for m in masks])
    least = min(m[-1] + 1 for m in masks)
    places = F.greatest(F.size("w") - F.lit(least - 1), F.lit(0)) * F.lit(len(masks))
    numbers = F.when(places > 0, F.sequence(F.lit(0), places - 1)).otherwise(F.array().cast("array<int>"))
    spread = table.select(*keep, "w", F.explode(numbers).alias("number"))
    pos = F.expr(f"CAST(number DIV {len(masks)} AS INT)")
    spread = spread.select(*keep, "w", pos.alias("pos"), (F.col("number") % len(masks)).alias("mask"))
    spread = spread.where(F.col("pos") + spans[F.col("mask")] <= F.size("w"))
    seed = None
    for i, mask in enumerate(masks):
        picked = _seed(i, mask, F.col("pos"))
        seed = picked if seed is None else F.when(F.col("mask") == i, picked).otherwise(seed)
    return spread.select(*keep, "w", "pos", "mask", seed.alias("seed"))


def _short_seeds(items: DataFrame, sizes: list[int], masks: list[tuple[int, ...]], percent: int) -> DataFrame:
    """(item_id, part, w, pos, mask, seed) of the items that are shorter than the window."""
    found = None
    for size in sizes:
        taken, places = short_blocks(size, percent)
        number = masks.index(tuple(range(taken)))
        places = F.array(*[F.lit(p) for p in places])
        found = F.when(F.size("w") == size, F.transform(places, lambda p: F.struct(
            p.alias("pos"), F.lit(number).alias("mask"), _seed(number, masks[number], p).alias("seed")  # noqa: B023
        ))).otherwise(found)
    return items.select("item_id", "part", "w", F.explode(found).alias("s")).select("item_id", "part", "w", "s.*")


def _follows_a_hit() -> Column:
    """The place before matches under the same mask, so this hit is no head of a chain."""
    out = F.lit(False)
    for i, mask in enumerate(MASKS):
        same = [F.col("w")[F.col("pos") + (o - 1)] == F.col("item_words")[F.col("item_pos") + (o - 1)] for o in mask]
        out = F.when(F.col("mask") == i, reduce(lambda a, b: a & b, same)).otherwise(out)
    return F.when((F.col("pos") > 0) & (F.col("item_pos") > 0), out).otherwise(F.lit(False))


def overlaps(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, item_id, start_word, agreeing, compared): the best overlap of each such pair."""
    items = (
        benchmark.where("text IS NOT NULL AND item_id IS NOT NULL")
        .select("item_id", word_codes(F.col("text")).alias("w"))
        .groupBy("w")
        .agg(F.min("item_id").alias("item_id"))
        .where(F.size("w") > 0)
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PART - window + 1))
    parts = items.select("item_id", "w", F.explode(starts).alias("part")).select(
        "item_id", "part", F.slice("w", F.col("part") + 1, F.lit(PART)).alias("w")
    )
    total, sizes = items.agg(
        F.sum(F.size("w") * len(MASKS)), F.collect_set(F.when(F.size("w") < window, F.size("w")))
    ).first()
    sizes = sorted(sizes)
    masks = list(MASKS) + [tuple(range(n)) for n in sorted({short_blocks(size, percent)[0] for size in sizes})]
    total = total or 0
    blocks = -(-int(total) // BLOCK_SEEDS) or 1
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", word_codes(F.col("text")).alias("w")
    )
    found = []
    for block in range(blocks):
        some = parts.where(F.pmod(F.hash("item_id", "part"), F.lit(blocks)) == block)
        known = probes(some.where(F.size("w") >= window), ["item_id", "part"], list(MASKS))
        if sizes:
            known = known.unionByName(_short_seeds(some.where(F.size("w") < window), sizes, masks, percent))
        known = known.select("seed", F.col("mask").alias("item_mask"), "item_id", "part", F.col("pos").alias("item_pos"))
        hits = (
            probes(texts, ["doc_id"], masks)
            .join(F.broadcast(known), "seed")
            .where("mask = item_mask")
            .join(F.broadcast(some.withColumnRenamed("w", "item_words")), ["item_id", "part"])
            .where(~_follows_a_hit())
        )
        found.append(_verified(hits, window, percent))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("agreeing", F.negative("start_word").alias("back"), "compared")).alias("best")
    ).select(
        "doc_id", "item_id", F.negative("best.back").alias("start_word"), "best.agreeing", "best.compared"
    )


def _verified(hits: DataFrame, window: int, percent: int) -> DataFrame:
    """Hits whose alignment holds a window that agrees in enough words; each is compared once."""
    shift = F.col("pos") - F.col("item_pos")
    compared = F.least(F.lit(window), F.size("item_words"))
    begin = F.greatest(F.lit(0), shift)
    same = F.transform(
        F.sequence(
            F.greatest(F.lit(0), -shift), F.least(F.size("item_words"), F.size("w") - shift) - F.lit(1)
        ),
        lambda t: (F.col("w")[t + shift] == F.col("item_words")[t]).cast("int"),
    )

    def best(line: Column) -> Column:
        return F.array_max(F.transform(
            F.sequence(F.lit(1), F.size(line) - compared + F.lit(1)),
            lambda i: F.struct(
                F.aggregate(F.slice(line, i, compared), F.lit(0), lambda a, b: a + b).alias("agreeing"), (-i).alias("back")
            ),
        ))

    enough = F.transform(F.filter(F.array(same), lambda line: F.size(line) >= compared), best)
    enough = F.filter(enough, lambda x: F.lit(100) * x["agreeing"] >= F.lit(percent) * compared)
    found = unnest(hits.select("doc_id", "item_id", "w", "item_words", "pos", "item_pos"), enough, "doc_id", "item_id", begin.alias("begin"), compared.alias("compared"), pos="n", item="best")
    return found.select(
        "doc_id", "item_id", (F.col("begin") - F.col("best.back") - 1).alias("start_word"),
        F.col("best.agreeing").alias("agreeing"), "compared",
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that overlap no benchmark item; rows with a null id stay."""
    found = scratch.save(overlaps(documents, benchmark).select("doc_id").distinct(), "contaminated")
    return documents.join(found, "doc_id", "left_anti")


def op5_spaced_seed_overlaps(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it overlaps."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return overlaps(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Brute force: every alignment of every item with every document that shares one word at it.
OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
    WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), b AS (
  SELECT item_id, generate_subscripts(w, 1) - 1 AS ipos, unnest(w) AS word, len(w) AS m FROM (
    SELECT min(item_id) AS item_id, w FROM (
      SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL
    ) GROUP BY w HAVING len(w) > 0)
), same AS (
  SELECT doc_id, item_id, pos - ipos AS shift, ipos, n, m, least({WINDOW}, m) AS compared
  FROM d JOIN b USING (word)
), busy AS (
  SELECT doc_id, item_id, shift FROM same GROUP BY ALL HAVING 100 * count(*) >= {PERCENT} * any_value(compared)
), lined AS (
  SELECT same.* FROM same JOIN busy USING (doc_id, item_id, shift)
), windows AS (
  SELECT doc_id, item_id, shift, compared, t AS first,
    (SELECT count(*) FROM lined l WHERE l.doc_id = g.doc_id AND l.item_id = g.item_id AND l.shift = g.shift
      AND l.ipos BETWEEN t AND t + g.compared - 1) AS agreeing
  FROM (SELECT doc_id, item_id, shift, any_value(compared) AS compared,
          unnest(generate_series(greatest(0, -shift), least(any_value(m), any_value(n) - shift) - any_value(compared))) AS t
        FROM lined GROUP BY doc_id, item_id, shift) g
), best AS (
  SELECT doc_id, item_id, max(struct_pack(agreeing := agreeing, back := -(first + shift), compared := compared)) AS x
  FROM windows WHERE 100 * agreeing >= {PERCENT} * compared GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(-x.back AS INTEGER) AS start_word, CAST(x.agreeing AS INTEGER) AS agreeing,
  CAST(x.compared AS INTEGER) AS compared FROM best
"""
