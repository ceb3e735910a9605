"""N-gram Jaccard join by prefix filters under several global orders of the shingles.

Two sets that reach the threshold must share a shingle within their prefixes (the first
``n - ceil(t n) + 1`` shingles) under *every* total order of all shingles. The first order is by
the number of sets that hold a shingle, rarest first; the others are independent hash orders. A pair is
verified only if it passes the filter of each order, and if parity sketches of the two sets do not rule
it out (they bound the symmetric difference from below, so they lose nothing).

A set whose prefix is filled by shingles that no other set has links with nothing. Most sets are told
so by a quarter of all shingles, chosen by their hashes and counted exactly. They leave, and of the others
all shingles are counted. So what sets share by chance, or in less than the threshold asks for, does not
become candidates, and the shingles joined on grow with the documents that share nearly all they have.

A shingle of many documents must not become all their pairs. Sets are nodes of a graph, so equal
sets are one node, and work runs in two steps that together are exact for connected groups:

1. Each document is compared with one pivot per prefix shingle (linear), the one whose shingles are
   shared most. Links make groups. Once more, with pivots outside each shingle's largest group.
2. Candidate pairs whose ends are still in different groups are compared, driven by the documents
   outside the shingle's largest group. Pairs inside a group can add nothing.

Null texts and texts without words have no shingles and link with nothing. A document with fewer
words than the shingle length has one shingle, its whole word sequence. Repeated rows and equal
texts are one node. Rows with a null id keep
their set size, have a null component and link with nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.shared import PASS_BYTES, Scratch, mix, shingle_hashes, text_chunks, word_hashes
from folioflow.llm.sketch import may_hold, set_filter

WORDS = 4
PERCENT = 85
#: Seeds of the second and the third order.
_SEEDS = (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)
#: Of so many shingles, told by their hashes, one is counted for every set.
SAMPLE = 4
#: Shingles that a task counts in one pass, about 90 bytes each.
COUNTED = 2 << 20


def _sets(batch, k: int):
    """(row, sorted distinct shingle hashes) for each row of an Arrow batch."""
    words, counts = word_hashes(batch.column("text"))
    hashes, per_row = shingle_hashes(words, counts, k)
    stops = np.cumsum(per_row)
    for row, (stop, n) in enumerate(zip(stops.tolist(), per_row.tolist(), strict=True)):
        yield row, np.unique(hashes[stop - n : stop])


def _fingerprint(found: np.ndarray) -> int:
    both = np.stack([np.bitwise_xor.reduce(mix(found + np.uint64(7)), keepdims=True), found.sum(keepdims=True)])
    return int(mix(mix(both[0]) + both[1] * np.uint64(3) + np.uint64(len(found)))[0].view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Shingles to keep so that two sets reaching the threshold share one of them."""
    return n - -(-percent * n // 100) + 1


def _hash_order(found: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix in a hash order; 32 bits of each hash, since a filter may pass too much."""
    order = mix(found ^ np.uint64(seed))
    p = prefix_length(len(found), percent)
    kept = np.partition(order, p - 1)[:p] if p < len(found) else order
    return (kept >> np.uint64(32)).astype(np.uint32).view(np.int32)


def profiles(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, fp, sample): set size, set fingerprint and the sampled shingles."""

    def describe(batches):
        for piece in text_chunks(batches, size=PASS_BYTES):
            sets = [found for _, found in _sets(piece, k)]
            samples = [s[s % np.uint64(SAMPLE) == 0].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(samples, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "fp", "sample"],
            )

    schema = "doc_id bigint, n_shingles bigint, fp bigint, sample array<bigint>"
    return documents.select("doc_id", "text").mapInArrow(describe, schema)


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of shingles falls on them; four to eight bits a shingle.

    The bits in which two sketches of one length differ are at most the shingles that only one of
    the sets has. A sketch of half the length is the exclusive or of its halves.
    """
    bits = 1 << max(6, (4 * len(found) - 1).bit_length())
    places = (mix(found ^ np.uint64(0x0F0F0F0F0F0F0F0F)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def least_difference(left: np.ndarray, right: np.ndarray) -> int:
    """A lower bound of the shingles that only one of two sets has, from their sketches."""
    while len(left) != len(right):
        if len(left) < len(right):
            left, right = right, left
        half = len(left) // 2
        left = left[:half] ^ left[half:]
    return int(np.bitwise_count(left ^ right).sum())


def _described(documents: DataFrame, wanted, k: int, schema: str, describe: Callable) -> DataFrame:
    """(fp, ...) of the documents whose ids pass a set filter, one row for each set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for piece in text_chunks([batch.filter(pa.array(may_hold(wanted.value, ids)))], size=PASS_BYTES):
                kept = {}
                for _, found in _sets(piece, k):
                    if len(found) and (fp := _fingerprint(found)) not in seen:
                        seen.add(fp)
                        kept[fp] = found
                columns = [pa.array(list(kept), pa.int64()), *describe(list(kept.values()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(run, schema).dropDuplicates(["fp"])


def _signatures(documents: DataFrame, wanted, k: int, percent: int) -> DataFrame:
    """(fp, second, third, sketch): the prefixes in the hash orders and the parity sketch."""

    def describe(sets):
        orders = [[_hash_order(s, seed, percent) for s in sets] for seed in _SEEDS]
        sketches = [parity_sketch(s).tobytes() for s in sets]
        return [*(pa.array(o, pa.list_(pa.int32())) for o in orders), pa.array(sketches, pa.binary())]

    schema = "fp bigint, second array<int>, third array<int>, sketch binary"
    return _described(documents, wanted, k, schema, describe)


def _whole_sets(documents: DataFrame, wanted, k: int) -> DataFrame:
    def describe(sets):
        return [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

    return _described(documents, wanted, k, "fp bigint, shingles array<bigint>", describe)


def _near_enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) whose sketches do not rule the threshold out."""

    def keep(batches):
        for batch in batches:
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            total = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()).tolist()
            # the threshold holds if and only if (100 + percent) * difference <= (100 - percent) * total
            passed = [
                (100 + percent) * least_difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                <= (100 - percent) * n
                for x, y, n in zip(sa, sb, total, strict=True)
            ]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(passed, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(keep, "a bigint, b bigint, na bigint, nb bigint")


def _alone(least: DataFrame) -> DataFrame:
    """(fp, alone) from the only holder of each shingle, `fp`: how many shingles no other set has."""
    return least.groupBy("fp").agg(F.count("*").alias("alone"))


def _prefix_left(percent: int) -> Column:
    """How many shingles of the prefix are not alone: `prefix_length` less `alone`."""
    n = F.col("n_shingles")
    return n - F.ceil(n * percent / F.lit(100)) + 1 - F.col("alone")


class _Join:
    """The tables that the two steps of one join share; a node is a distinct shingle set."""

    def __init__(self, documents: DataFrame, scratch: Scratch, k: int, percent: int):
        self.documents, self.scratch, self.k, self.percent = documents, scratch, k, percent
        self.context = documents.sparkSession.sparkContext
        self.rows = scratch.save(profiles(documents, k), "profiles")
        self.linkable = self.rows.where("fp IS NOT NULL AND doc_id IS NOT NULL")

    def counted(self, held: DataFrame, source: DataFrame, share: int, count: Callable, name: str) -> DataFrame:
        """count(rows) of all rows of held (token, fp), taken in passes over parts of the shingles.

        held has one row for each `share` of the n_shingles of the rows of `source`. Shingles are nearly distinct,
        so tasks hold them all: without passes, few tasks would sort and spill several times the input.
        """
        spark = held.sparkSession
        rows = (source.agg(F.sum("n_shingles")).first()[0] or 0) // share
        tasks = min(held.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        passes = -(-rows // (COUNTED * max(tasks, 1))) or 1
        found = []
        for turn in range(passes):
            part = held.where(F.pmod(F.shiftright("token", 8), F.lit(passes)) == turn) if passes > 1 else held
            found.append(self.scratch.save(count(part), f"{name}/{turn}"))
            self.scratch.release()
        return reduce(DataFrame.unionByName, found)

    def open_sets(self) -> DataFrame:
        """(fp, n_shingles, alone) of the sets whose prefix is not filled by sampled shingles of their own."""

        def count(sampled):
            holders = sampled.groupBy("token").agg(F.min("fp").alias("fp"), F.max("fp").alias("most"))
            return _alone(holders.where("fp = most"))

        sampled = self.linkable.select(F.explode("sample").alias("token"), "fp")
        lone = self.counted(sampled, self.linkable, SAMPLE, count, "sampled")
        sets = self.linkable.select("fp", "n_shingles").distinct()
        return self._left(sets, lone.groupBy("fp").agg(F.sum("alone").alias("alone")))

    def _left(self, sets: DataFrame, alone: DataFrame) -> DataFrame:
        sets = sets.join(alone, "fp", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("bigint")))
        return sets.where(_prefix_left(self.percent) > 0)

    def prefixes(self) -> DataFrame:
        """(fp, n, alone, prefix) of the sets that may link: what is not alone in the prefix, in order.

        A rank, the magnitude of the number of holders above 58 bits of the hash, names its shingle.
        Sets that left before link with nothing, so they do not count as holders.
        """
        sets = self.scratch.save(self.open_sets(), "open-sets")
        firsts = self.firsts().join(sets.select("fp"), "fp", "left_semi").select("doc_id")
        firsts = self.scratch.save(firsts, "open-firsts")
        wanted = self.context.broadcast(set_filter(firsts, firsts.count()))
        whole = _whole_sets(self.documents, wanted, self.k).join(sets.select("fp"), "fp", "left_semi")
        held = self.scratch.save(whole, "open-whole").select(F.explode("shingles").alias("token"), "fp")

        def count(rows):
            return rows.groupBy("token").agg(F.count("*").alias("sets"), F.min("fp").alias("fp"))

        holders = self.counted(held, sets, 1, count, "holders")
        left = self.scratch.save(self._left(sets.drop("alone"), _alone(holders.where("sets = 1"))), "left")
        level = F.least(F.ceil(F.log2("sets")), F.lit(31)).cast("bigint")
        rank = F.shiftleft(level, 58).bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << 58) - 1)))
        ranked = (
            held.join(left.select("fp"), "fp", "left_semi")
            .join(holders.where("sets > 1").select("token", rank.alias("rank")), "token")
            .groupBy("fp").agg(F.sort_array(F.collect_set("rank")).alias("ranks"))
        )
        prefix = F.slice("ranks", F.lit(1), _prefix_left(self.percent).cast("int"))
        found = left.join(ranked, "fp").select("fp", F.col("n_shingles").alias("n"), "alone", prefix.alias("prefix"))
        found = self.scratch.save(found, "prefixes")
        for table in ("open-sets", "open-firsts", "open-whole", "sampled", "holders", "left"):
            self.scratch.drop(table)
        return found

    def shared_shingles(self) -> DataFrame:
        """(token, fp, n, pos, last, own, alone, score) of the prefix shingles that different sets share.

        pos is the place in the prefix, last its last shingle. Of shingles that exactly the same sets hold,
        the first stands for all. The score is the share of a set's shingles that others have, too: an
        original scores above its changed copies. `own` is the number of shingles in its prefix that are
        in no other prefix, `alone` that of all its shingles that are in no other set.
        """
        held = self.prefixes().select(
            "fp", "n", "alone", F.element_at("prefix", -1).alias("last"), F.size("prefix").alias("others"),
            F.posexplode("prefix").alias("at", "token"),
        )
        lists = held.groupBy("token").agg(
            F.count("*").alias("sets"), F.bit_xor(F.xxhash64("fp")).alias("x"),
            F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"),
        )
        lists = self.scratch.save(lists.where("sets > 1"), "lists")
        held = self.scratch.save(held.join(lists.select("token"), "token"), "held")
        chosen = lists.groupBy("sets", "x", "y").agg(F.min("token").alias("token"))
        own = held.groupBy("fp").agg((F.max("alone") + F.max("others") - F.count("*")).alias("own"))
        tokens = held.join(chosen.select("token"), "token").join(own, "fp")
        pos, score = F.col("alone") + F.col("at"), F.lit(1) - F.col("alone") / F.col("n")
        tokens = tokens.select("token", "fp", "n", pos.alias("pos"), "last", "own", "alone", score.alias("score"))
        tokens = self.scratch.save(tokens, "tokens")
        for table in ("held", "lists", "prefixes"):
            self.scratch.drop(table)
        return tokens

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs (a, b, na, nb), those that reach the threshold."""
        wanted = self.scratch.save(pairs.distinct(), f"pairs-{name}")
        signatures = self.scratch.save(
            _signatures(self.documents, self.holders(wanted, name), self.k, self.percent), f"signatures-{name}"
        )
        passed = (
            wanted.join(signatures.toDF("a", "a2", "a3", "sa"), "a")
            .join(signatures.toDF("b", "b2", "b3", "sb"), "b")
            .where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
        )
        passed = self.scratch.save(_near_enough(passed, self.percent), f"passed-{name}")
        for table in ("signatures", "pairs", "holders"):
            self.scratch.drop(f"{table}-{name}")
        sets = _whole_sets(self.documents, self.holders(passed, name), self.k)
        sets = self.scratch.save(sets, f"sets-{name}")
        common = F.size(F.array_intersect("sa", "sb"))
        reached = F.lit(100) * F.col("common") >= F.lit(self.percent) * (
            F.col("na") + F.col("nb") - F.col("common")
        )
        found = self.scratch.save(
            passed.join(sets.toDF("a", "sa"), "a")
            .join(sets.toDF("b", "sb"), "b")
            .select("a", "b", "na", "nb", common.alias("common"))
            .where(reached)
            .select("a", "b"),
            f"links-{name}",
        )
        for table in ("sets", "passed", "holders"):
            self.scratch.drop(f"{table}-{name}")
        return found

    def firsts(self) -> DataFrame:
        """(fp, doc_id): the smallest document with each set."""
        return self.linkable.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))

    def holders(self, pairs: DataFrame, name: str):
        """A broadcast set filter of, for each end of the pairs, the smallest document with that set."""
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        held = self.scratch.save(self.firsts().join(ends, "fp", "left_semi").select("doc_id"), f"holders-{name}")
        return self.context.broadcast(set_filter(held, held.count()))


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and prefixes leave it open that two sets reach the threshold.

    What is in the prefix that ends first and in the other set is in the other prefix, too. So the
    shingles that only this prefix has are not common to the two sets. Nor are those that no other set has.
    """
    nx, ny = F.col(f"{x}_n"), F.col(f"{y}_n")
    common = F.when(F.col(f"{x}_last") <= F.col(f"{y}_last"), nx - F.col(f"{x}_own")).otherwise(ny - F.col(f"{y}_own"))
    common = F.least(common, nx - F.col(f"{x}_alone"), ny - F.col(f"{y}_alone"))
    sizes = F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny)
    return sizes & (F.lit(100 + percent) * common >= F.lit(percent) * (nx + ny))


def _pair(x: str, y: str) -> list[Column]:
    """Columns a, b, na, nb of a pair of sets, in the order of their numbers."""
    first = F.col(x) < F.col(y)
    nx, ny = F.col(f"{x}_n"), F.col(f"{y}_n")
    return [
        F.least(x, y).alias("a"), F.greatest(x, y).alias("b"),
        F.when(first, nx).otherwise(ny).alias("na"), F.when(first, ny).otherwise(nx).alias("nb"),
    ]


def _first_common(x: str, y: str, percent: int) -> Column:
    """Whether the shingle can be the first that two sets share: enough of both must follow it."""
    nx, ny = F.col(f"{x}_n"), F.col(f"{y}_n")
    after = F.least(nx - F.col(f"{x}_pos"), ny - F.col(f"{y}_pos"))
    return F.lit(100 + percent) * after >= F.lit(percent) * (nx + ny)


_OF_SET = ("n", "pos", "last", "own", "alone")


def _stars(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of each shingle's set of highest score with its other sets."""
    pivots = tokens.groupBy("token").agg(F.max(F.struct("score", "fp", *_OF_SET)).alias("top"))
    pivots = pivots.select("token", F.col("top.fp").alias("pivot"), *[F.col(f"top.{c}").alias(f"pivot_{c}") for c in _OF_SET])
    others = tokens.select("token", "fp", *[F.col(c).alias(f"fp_{c}") for c in _OF_SET])
    pairs = others.join(pivots, "token").where((F.col("fp") != F.col("pivot")) & _possible("fp", "pivot", percent))
    return pairs.select(*_pair("fp", "pivot"))


def _open(tokens: DataFrame, groups: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of the shingles whose sets are in several groups, with `component` and the largest, `main`."""
    held = tokens.join(groups.toDF("fp", "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    held = scratch.save(held, f"{name}-grouped")
    sizes = held.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = (
        sizes.groupBy("token")
        .agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("token", "main")
    )
    rows = scratch.save(held.join(mixed, "token"), name)
    scratch.drop(f"{name}-grouped")
    return rows


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between the groups of each shingle.

    One end is always outside the shingle's largest group, so a shingle of one large group and few
    others gives few pairs. A pair comes from the first shingle that it shares, which lies early in
    both prefixes; there a changed copy has shingles of its own.
    """
    minor = rows.where("component <> main").select(
        "token", F.col("fp").alias("x"), F.col("component").alias("cx"), *[F.col(c).alias(f"x_{c}") for c in _OF_SET]
    )
    others = rows.select("token", "fp", "component", "main", *[F.col(c).alias(f"fp_{c}") for c in _OF_SET])
    between = F.expr("component <> cx AND (component = main OR x < fp)")
    fits = between & _possible("x", "fp", percent) & _first_common("x", "fp", percent)
    return others.join(minor, "token").where(fits).select(*_pair("x", "fp"))


def jaccard_groups(
    documents: DataFrame, scratch: Scratch, k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    component_id is the smallest doc_id that links reach, links being pairs of shingle sets whose
    Jaccard similarity is at least `percent` / 100.
    """
    join = _Join(documents, scratch, k, percent)
    tokens = join.shared_shingles()
    links = join.links(_stars(tokens, percent), "stars")
    groups = components(links, scratch, "groups")
    rows = _open(tokens, groups, scratch, "open")
    scratch.drop("tokens")
    # what hangs together but not on the first pivots: pivots outside the largest group
    more = join.links(_stars(rows.where("component <> main"), percent), "more")
    links = scratch.save(links.union(more), "links")
    groups = components(links, scratch, "regrouped")
    rows = _open(rows.drop("component", "main"), groups, scratch, "reopened")
    scratch.drop("open")
    rest = join.links(_across(rows, percent), "rest")
    scratch.drop("reopened")
    final = components(links.union(rest), scratch, "final")

    named = join.linkable.join(final.toDF("fp", "component"), "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "component").select("doc_id", "n_shingles", "component_id")
    alone = join.rows.where("fp IS NULL OR doc_id IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone)


def jaccard_kept(
    documents: DataFrame, scratch: Scratch, k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The documents left when of each group only the one that names it stays.

    Rows with a null id stay; of rows with the same id all stay or none.
    """
    groups = jaccard_groups(documents, scratch, k, percent)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(documents, Scratch(spark))
