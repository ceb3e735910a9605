"""Phrase collocations from an FM-index per shard over word ids.

A shard is up to SHARD_WORDS words of one language inside one task, so no text is shuffled. Its words
become ids and its index holds two Burrows-Wheeler transforms, of the id sequence and of its reverse,
with suffixes sorted to the depth of the longest phrase, which is all that intervals of that depth read.
A phrase is a pair of intervals, one in each transform. Extending it to the left by every word that
precedes it splits its rows in the first transform and narrows the second interval in step; extending it
to the right does the same with the roles changed. Level by level this lists every phrase of at most
`max_words` words with its count in the shard; the phrases go packed into one
block a shard and bucket to the sums over all shards, taken bucket by bucket. The number of buckets grows
with the text, so a bucket is small; a phrase is in a bucket once a shard.

Every part of a candidate is at least as frequent as the candidate, so all that scores, cuts and the
containment rule need are sums of `min_count` and more. Those few are written once and joined by phrase.

Texts without words and null texts give nothing; a null language counts as `und`; repeated rows count
as often as they occur, rows with a null doc_id too. Ties in rank go to the higher count and then to the
lesser phrase in byte order. Products are decimals of 38 digits: exact for counts below 10^16. A text
longer than a shard is cut between pieces; a single piece is never cut. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.shared import Scratch, column_bytes, mix, text_chunks, word_hashes
from folioflow.operators.lineage import broadcast_if_small

SHARD_WORDS = 1 << 20
#: Bytes of text whose phrases share a bucket, that is are summed in one piece: some 200,000 rows.
BUCKET_BYTES = 1 << 20
MAX_WORDS = 3
MIN_COUNT = 10
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN = "und"

#: Characters that end a piece; the first stands for all of them once a text is folded.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + _ENDS + b"\x09",
    bytes(range(ord("a"), ord("z") + 1)) + b"." * len(_ENDS) + b" ",
)
_BLOCK = (("bucket", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("block", pa.binary()))
_CODEC = pa.Codec("zstd", compression_level=1)
#: Rows that are summed together while a bucket is read.
_SUM_ROWS = 1 << 21


_FACTORS = [f | np.uint64(1) for f in mix(np.arange(1, 65, dtype=np.uint64))]


def tokens(text: str) -> list[bytes]:
    """Words of the folded text, with `.` between and after its pieces."""
    return (text.encode("utf-8", "replace").translate(_FOLD) + b".").replace(b".", b" . ").split()


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of `codes`, sorted by the `depth` ids from there on (0 beyond the end), ties by place."""
    bits = max(1, int(codes.max(initial=0)).bit_length())
    known = max(1, min(depth, 63 // bits))
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.int64)
    ranks = padded[: len(codes)].copy()
    for j in range(1, known):
        ranks = (ranks << bits) | padded[j : j + len(codes)]
    while True:
        order = np.argsort(ranks, kind="stable")
        if known >= depth:
            return order
        ordered = ranks[order]
        dense = np.empty(len(codes), np.int64)
        dense[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        step = min(known, depth - known)
        ahead = np.concatenate([dense[step:], np.zeros(step, np.int64)])
        ranks, known = dense * (len(codes) + 1) + ahead, known + step


class Transform:
    """One direction: the id before each sorted suffix, and the row that its suffix has."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.order = suffix_order(codes, depth)
        self.before = codes[self.order - 1]  # place 0 is preceded by the last id, which ends a piece
        self.step = np.empty(len(codes), np.int64)
        self.step[np.argsort(self.before, kind="stable")] = np.arange(len(codes))


class PhraseIndex:
    """Bidirectional index over ids; id 0 ends a piece. `codes` must end with 0."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.codes = codes
        self.ahead = Transform(codes, depth)
        # the reverse starts with the final 0, so that it ends a piece there, too
        self.back = Transform(np.roll(codes[::-1], -1), depth)

    def root(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The empty phrase: first rows in both transforms, and the number of rows."""
        zero = np.zeros(1, np.int64)
        return zero, zero, np.array([len(self.codes)], np.int64)

    def extend(self, intervals, left: bool):
        """All phrases one word longer than the given ones, to the left or to the right."""
        near, far, sizes = intervals if left else (intervals[1], intervals[0], intervals[2])
        side = self.ahead if left else self.back
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        rows = np.arange(len(owner)) + (near - begin)[owner]
        words = side.before[rows]
        keys = owner * (int(self.codes.max(initial=0)) + 1) + words  # stable: equal words keep their rows' order
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        counts = np.diff(np.append(first, len(keys)))
        lead = order[first]
        kept = words[lead] != 0
        first, lead, counts = first[kept], lead[kept], counts[kept]
        new_near = side.step[rows[lead]]
        new_far = far[owner[lead]] + first - begin[owner[lead]]
        return (new_near, new_far, counts) if left else (new_far, new_near, counts)

    def phrases(self, max_words: int):
        """(words, places of one occurrence, counts) for each number of words up to `max_words`."""
        found = self.root()
        for words in range(1, max_words + 1):
            found = self.extend(found, left=words % 2 == 0)
            yield words, self.ahead.order[found[0]], found[2]


class _Shard:
    """Texts of one language as ids; `.` has id 0 and other words are numbered as they come."""

    def __init__(self):
        self.numbers = defaultdict(itertools.count().__next__)
        self.numbers[b"."]
        self.parts, self.size = [], 0

    def add(self, found: list[bytes]) -> None:
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.parts.append(ids)
        self.size += len(ids)

    def phrases(self, max_words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Phrases, their counts and their hashes; the empty phrase counts the words."""
        codes = np.concatenate(self.parts)
        codes = codes[(codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)]  # one 0 between pieces
        names = pa.array(self.numbers, pa.binary()).cast(pa.string())
        hashes, _ = word_hashes(names)
        phrases, sizes, sums = [pa.array([""])], [np.array([np.count_nonzero(codes)])], [np.zeros(1, np.uint64)]
        for words, places, counts in PhraseIndex(codes, max_words).phrases(max_words) if len(codes) else ():
            held = [codes[places + j] for j in range(words)]
            phrases.append(pc.binary_join_element_wise(*[names.take(pa.array(h)) for h in held], " "))
            sizes.append(counts)
            sums.append(sum(hashes[h] * _FACTORS[j] for j, h in enumerate(held)))
        return pa.concat_arrays(phrases), np.concatenate(sizes), mix(np.concatenate(sums))


def _blocks(lang: str, shard: _Shard, max_words: int, buckets: int):
    """Record batches (bucket, lang, size, block): a shard's phrases packed by bucket, in index order."""
    phrases, counts, hashes = shard.phrases(max_words)
    bucket = ((hashes ^ np.uint64(zlib.crc32(lang.encode()))) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, counts, phrases = bucket[order], counts[order], phrases.take(pa.array(order))
    data, offsets = column_bytes(phrases)
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    found = []
    for start, stop in itertools.pairwise(edges.tolist()):
        lengths = np.diff(offsets[start : stop + 1]).astype(np.int32)
        raw = counts[start:stop].tobytes() + lengths.tobytes() + data[offsets[start] : offsets[stop]].tobytes()
        found.append((int(bucket[start]), lang, stop - start, len(raw), _CODEC.compress(raw, asbytes=True)))
        if len(found) == 256 or stop == len(bucket):
            columns = zip(zip(*found, strict=True), _BLOCK, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in columns], names=[n for n, _ in _BLOCK])
            found = []


def _summed(batches, min_count: int):
    """Record batches (lang, phrase, f) of blocks that come sorted by bucket."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(n).to_pylist() for n, _ in _BLOCK), strict=True)

    def total(parts):
        return pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])

    for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
        parts, waiting = [], 0
        for _, lang, n, size, block in group:
            raw = _CODEC.decompress(block, size)
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 8 * n))]).astype(np.int32)
            phrases = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw.slice(12 * n)))
            langs = pa.repeat(pa.scalar(lang, pa.string()), n)
            parts.append(pa.table({"lang": langs, "phrase": phrases, "f": np.frombuffer(raw, np.int64, n)}))
            waiting += n
            if waiting >= _SUM_ROWS:
                parts = [total(parts)]
                waiting = len(parts[0]) // 2
        sums = total(parts)
        kept = pc.or_(pc.greater_equal(sums["f"], min_count), pc.equal(sums["phrase"], ""))
        yield from sums.filter(kept).to_batches()


def _shards(batches, limit: int):
    """(lang, shard) of about `limit` words each; at most twice the limit waits at any time."""
    waiting = defaultdict(_Shard)
    for batch in text_chunks(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            found = tokens(text)
            while len(found) > limit and b"." in found[limit:-1]:
                cut = found.index(b".", limit) + 1
                long = _Shard()
                long.add(found[:cut])
                yield lang, long
                found = found[cut:]
            waiting[lang].add(found)
        sizes = {lang: shard.size for lang, shard in waiting.items()}
        while sizes and (max(sizes.values()) >= limit or sum(sizes.values()) >= 2 * limit):
            lang = max(sizes, key=sizes.get)
            sizes.pop(lang)
            yield lang, waiting.pop(lang)
    while waiting:
        yield waiting.popitem()


def phrase_counts(
    documents: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(lang, words, phrase, f): phrases of at least `min_count` occurrences; words 0 counts all words."""

    table = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)

    def pack(batches):
        for lang, shard in _shards(batches, shard_words):
            yield from _blocks(lang, shard, max_words, buckets)

    packed = table.mapInArrow(pack, "bucket bigint, lang string, n bigint, size bigint, block binary")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: _summed(batches, min_count), "lang string, phrase string, f bigint"
    )
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return found.select("lang", words.alias("words"), "phrase", "f")


def _score(a: Column, l: Column, r: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    top = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)")
    bottom = (wide[1] * wide[2]).cast("decimal(38,0)")
    # exact: no part is rarer than the whole, so the quotient is at most SCALE
    return F.call_function("div", top.cast("decimal(38,0)"), bottom)


def collocations(
    documents: DataFrame,
    scratch: Scratch,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one replaces."""
    counts = scratch.save(phrase_counts(documents, max_words, min_count, shard_words), "phrase-counts")
    many = counts.where("words >= 2").select("lang", "words", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    part = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"),
    )
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part.withColumnRenamed("part", side).withColumnRenamed("part_f", name), ["lang", side])
    best = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    inside = reduce(DataFrame.union, [
        many.where(F.col("words") > size).select(
            "lang",
            F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))).alias("phrase"),
            F.col("a").alias("longer"),
        )
        for size in range(2, max_words)
    ]) if max_words > 2 else many.select("lang", "phrase", F.col("a").alias("longer")).limit(0)
    longer = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    stays = F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(inside_percent) * F.col("a"))
    return (
        best.join(longer, ["lang", "phrase"], "left").where(stays).join(broadcast_if_small(totals), "lang")
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )


def top_collocations(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, count and phrase, with their rank.

    A language is ranked in hash parts first, so a hot one is never sorted in one task as a whole.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = found.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    ).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_collocations(collocations(documents, Scratch(spark)))


#: Plain counts of all word runs.
OP11_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), runs AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM worded, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(w) >= size)
), f AS (
  SELECT lang, phrase, size, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), cut AS (
  SELECT lang, phrase, size, f AS a, k, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2)) AS ks(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r,
    CAST(({SCALE}::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase, f FROM f WHERE size = 3
    UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), f FROM f WHERE size = 3
  ) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank,
  b.phrase, a, l, r, n, score
FROM best b JOIN totals USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE g.f IS NULL OR 100 * g.f < {INSIDE_PERCENT} * a
QUALIFY rank <= {TOP}
"""
