"""Embedding near-dedup over an inverted multi-index.

Each half of a unit vector has a codebook of its own (k-means on a bounded sample); a pair of codes is a
cell. Every vector lives in its own cell and visits the cells nearest to it in the order of the
multi-sequence algorithm: a heap over the two sorted lists of code distances. How many cells to visit
is measured: sampled queries are compared with *all* vectors, more of them until ENOUGH have a link, and
of those that have, the share TARGET must find *all* its links, so that a hot group does not stand for
lone pairs. All links found are verified in double precision.

Where links are too rare for that, or lie too far in the order, visits follow from a bound instead and
lose nothing: a linked vector that lives in another code's region has crossed the plane between both
codes, and the crossings of both halves add up to at most the distance of the least cosine. The bound
prunes little among vectors without clusters; cells are then made larger, down to one, whose blocks are
compared as matrix products.

Equal vectors are one node with a size. A cell is cut into blocks of residents and of visitors, so that a
hot cell is many bounded matrix products. A block gives what it adds to each node's number of links, and
a spanning forest of its links; pairs are never written. A pair that two blocks see counts in one:
the one where the visitor has the smaller number.

A vector that is null, empty, zero, or has a null or non-finite component links with nothing and is its
own component. Vectors of different lengths do not link. Repeated rows are vectors of their own. A
row with a null vec_id has no links and a null component, and is kept.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.graph import components
from folioflow.llm.shared import Scratch
from folioflow.llm.sketch import filled

COSINE = 0.95
#: Vectors that codebooks are fitted on, and queries that the visits are measured with, at most.
SAMPLE, QUERIES = 8192, 2048
MOST_QUERIES, ENOUGH = 32768, 200
SAMPLE_BYTES = 16 << 20
TARGET = 0.999
LEAST_VISITS, MOST_VISITS = 4, 1024
#: Vectors in a cell on average, and in a block of residents or visitors.
PER_CELL, RESIDENTS, VISITORS = 64, 256, 1024
MOST_CODES = 1024
#: Comparisons that cost as much as sending one copy of a vector.
COPY_COST = 512


def _unit(column: pa.Array) -> tuple[list, np.ndarray]:
    """The vectors as arrays (None if they cannot link), and their lengths."""
    out, widths = [], []
    for value in column:
        x = None
        if value.is_valid:
            raw = value.values
            if len(raw) and not raw.null_count:
                x = raw.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
                if not np.isfinite(x).all() or not x.any():
                    x = None
        out.append(x)
        widths.append(0 if x is None else len(x))
    return out, np.array(widths)


def vector_rows(embeddings: DataFrame, scratch: Scratch) -> DataFrame:
    """(vec_id, fp, width, data): fp names equal vectors; null where a vector cannot link."""
    wide = dict(embeddings.dtypes)["embedding"] == "array<double>"

    def describe(batches):
        for batch in batches:
            vectors, widths = _unit(batch.column("embedding"))
            data = [None if x is None else x.astype("<f8" if wide else "<f4").tobytes() for x in vectors]
            prints = [
                None if d is None else int.from_bytes(hashlib.blake2b(d, digest_size=8).digest(), "little", signed=True)
                for d in data
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array(prints, pa.int64()), pa.array(widths, pa.int32()),
                    pa.array(data, pa.binary()),
                ],
                names=["vec_id", "fp", "width", "data"],
            )

    table = embeddings.select(F.col("vec_id").cast("bigint"), "embedding")
    return scratch.save(table.mapInArrow(describe, "vec_id bigint, fp bigint, width int, data binary"), "rows")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision from a column of bytes, all of one width."""
    values = b"".join(v.as_py() for v in column)
    size = len(values) // max(len(column) * width, 1)
    x = np.frombuffer(values, "<f8" if size == 8 else "<f4").astype(float).reshape(len(column), width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the codes."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, size: int, turns: int = 10) -> np.ndarray:
    """k-means by Lloyd's steps from evenly picked rows."""
    codes = x[np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)].copy()
    for _ in range(turns):
        near = _nearest(x, codes).argmin(1)
        counts = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves for every width that the sample has; others have one cell.

    With a `bound`, vectors visit every cell that may hold one within this squared distance.
    """

    books: dict[int, tuple[np.ndarray, np.ndarray]]
    visits: int = LEAST_VISITS
    bound: float | None = None

    def cells(self, x: np.ndarray, visits: int) -> list[list[int]]:
        """For each unit vector the numbers of its cells to visit, its own first."""
        books = self.books.get(x.shape[1])
        if books is None:
            return [[0]] * len(x)
        half = x.shape[1] // 2
        first, second = _nearest(x[:, :half], books[0]), _nearest(x[:, half:], books[1])
        wide = len(books[1])
        if self.bound is not None:
            home = first.argmin(1) * wide + second.argmin(1)
            if visits == 1:
                return home[:, None].tolist()
            across = _crossing(first, books[0])[:, :, None] + _crossing(second, books[1])[:, None, :]
            near = across.reshape(len(x), -1) <= self.bound
            near[np.arange(len(x)), home] = False
            return [[h, *np.flatnonzero(n).tolist()] for h, n in zip(home.tolist(), near, strict=True)]
        orders = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
        return [
            [i * wide + j for i, j in multi_sequence(a, b, p, q, visits)]
            for a, b, p, q in zip(first, second, *orders, strict=True)
        ]


def _crossing(distances: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances from each row to the planes behind which another code is nearer than its own."""
    own = distances.argmin(1)
    apart = np.sqrt(_nearest(codes, codes))[own]
    more = distances - distances[np.arange(len(own)), own][:, None]
    return np.divide(more, 2 * apart, out=np.zeros_like(more), where=apart > 0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, by_a: np.ndarray, by_b: np.ndarray, visits: int):
    """The first pairs (i, j) in the order of a[i] + b[j]."""
    p, q = a[by_a].tolist(), b[by_b].tolist()
    by_a, by_b = by_a.tolist(), by_b.tolist()
    heap, seen = [(p[0] + q[0], 0, 0)], {(0, 0)}
    while heap and visits:
        _, i, j = heapq.heappop(heap)
        yield by_a[i], by_b[j]
        visits -= 1
        for n, m in ((i + 1, j), (i, j + 1)):
            if n < len(p) and m < len(q) and (n, m) not in seen:
                seen.add((n, m))
                heapq.heappush(heap, (p[n] + q[m], n, m))


def _by_width(batch: pa.RecordBatch):
    """(row numbers, unit vectors) for each width in a batch."""
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, _matrix(batch.column("data").take(pa.array(at)), int(width))


def _bounded_index(sample: dict[int, np.ndarray], total: int, cosine: float) -> MultiIndex:
    """The index of the least work whose visits lose no link."""
    bound = 2 - 2 * cosine + 1e-6
    books = {}
    for width, x in sample.items():
        half = width // 2
        asked, best = x[:: max(1, len(x) // 256)], float("inf")
        codes = 1
        while half and codes <= min(64, len(x)):
            tried = codebook(x[:, :half], codes), codebook(x[:, half:], codes)
            cells = MultiIndex({width: tried}, bound=bound).cells(asked, MOST_VISITS)
            visits = sum(map(len, cells)) / len(cells)
            living = total / (len(tried[0]) * len(tried[1]))
            work = visits * (living + COPY_COST * max(1, living / RESIDENTS))
            if work < best:
                best, books[width] = work, tried
            codes *= 2
    return MultiIndex(books, MOST_VISITS, bound)


def fit_index(nodes: DataFrame, cosine: float, target: float) -> MultiIndex:
    """Codebooks from a sample, and the visits that reach the target recall against brute force."""
    total, width = nodes.agg(F.count("*"), F.max("width")).first()
    if not total:
        return MultiIndex({})
    size = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    drawn = nodes.select("fp", "width", "data").orderBy("fp").limit(max(size, min(MOST_QUERIES, 4 * size))).toArrow()
    drawn = drawn.combine_chunks().to_batches()[0]
    prints = drawn.column("fp").to_numpy()
    sample = {}
    for at, x in _by_width(drawn.slice(0, size)):
        sample[x.shape[1]] = x
    books = {}
    for w, x in sample.items():
        codes = int(min(MOST_CODES, max(1, (total / PER_CELL) ** 0.5), len(x)))
        if w // 2:
            books[w] = codebook(x[:, : w // 2], codes), codebook(x[:, w // 2 :], codes)
    index = MultiIndex(books)
    begin, farthest = 0, np.zeros(0, np.uint32)
    while begin < drawn.num_rows and np.count_nonzero(farthest) < ENOUGH:
        some = drawn.slice(begin, QUERIES)
        farthest = np.concatenate([farthest, _farthest(nodes, index, some, prints[begin : begin + QUERIES], cosine)])
        begin += some.num_rows
    linked = np.sort(farthest[farthest > 0])
    if len(linked) >= ENOUGH:
        visits = int(linked[min(len(linked) - 1, int(np.ceil(target * len(linked))) - 1)])
        if visits <= MOST_VISITS:
            return MultiIndex(books, max(LEAST_VISITS, visits))
    return _bounded_index(sample, total, cosine)


def _farthest(
    nodes: DataFrame, index: MultiIndex, asked: pa.RecordBatch, prints: np.ndarray, cosine: float
) -> np.ndarray:
    """Visits each query needs to find all its links with all nodes (MOST_VISITS + 1: more), 0 without any."""
    queries = {x.shape[1]: (at, x) for at, x in _by_width(asked)}
    order = {
        w: [{cell: place for place, cell in enumerate(cells)} for cells in index.cells(x, MOST_VISITS)]
        for w, (_, x) in queries.items()
    }
    shared = nodes.sparkSession.sparkContext.broadcast((index, queries, order, prints))

    def measure(batches, needed):
        index, queries, order, prints = shared.value
        for batch in batches:
            names = batch.column("fp").to_numpy()
            for at, x in _by_width(batch):
                if x.shape[1] not in queries:
                    continue
                numbers, asked = queries[x.shape[1]]
                for begin in range(0, len(at), 1024):
                    some, own = x[begin : begin + 1024], names[at[begin : begin + 1024]]
                    q, y = np.nonzero(asked @ some.T >= cosine)
                    other = prints[numbers[q]] != own[y]
                    q, y = q[other], y[other]
                    met = np.unique(y)
                    home = dict(zip(met.tolist(), (c[0] for c in index.cells(some[met], 1)), strict=True)) if len(met) else {}
                    for i, j in zip(q.tolist(), y.tolist(), strict=True):
                        place = 1 + order[x.shape[1]][i].get(home[j], MOST_VISITS)
                        needed[numbers[i]] = max(needed[numbers[i]], place)

    size = 1 << max(6, (asked.num_rows - 1).bit_length())
    found = filled(nodes.select("fp", "width", "data"), measure, size, np.uint32, np.maximum)[: asked.num_rows]
    shared.destroy()
    return found


def _block_links(residents: pa.Table, visitors: pa.Table, cosine: float, width: int):
    """Arrays of one block's links: the node numbers of visitors, of residents, and the linked pairs."""
    y, x = _matrix(residents.column("data"), width), _matrix(visitors.column("data"), width)
    a, b = visitors.column("fp").to_numpy(), residents.column("fp").to_numpy()
    i, j = np.nonzero(x @ y.T >= cosine)
    other = a[i] != b[j]
    i, j = i[other], j[other]
    # does the resident visit the visitor's cell, too? under a bound both do
    if residents.column("visits").null_count:
        once = a[i] < b[j]
    else:
        visits = residents.column("visits").combine_chunks().flatten().to_numpy().reshape(len(b), -1)
        home = visitors.column("home").to_numpy()
        both = (visits[j] == home[i][:, None]).any(axis=1)
        once = ~both | (a[i] < b[j])
    return a, b, i[once], j[once]


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the pairs (a[i], b[j]) join, fewer than there are nodes."""
    nodes, where = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
    left, right = where[: len(i)], where[len(i) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def near_vectors(
    embeddings: DataFrame, scratch: Scratch, cosine: float = COSINE, target: float = TARGET
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding)."""
    rows = vector_rows(embeddings, scratch)
    linkable = rows.where("fp IS NOT NULL AND vec_id IS NOT NULL")
    nodes = scratch.save(
        linkable.groupBy("fp").agg(
            F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("width").alias("width"),
            F.first("data").alias("data"),
        ),
        "nodes",
    )
    fitted = fit_index(nodes, cosine, target)
    bounded = fitted.bound is not None
    index = nodes.sparkSession.sparkContext.broadcast(fitted)

    def place(batches):
        index = index_value()
        for batch in batches:
            visits: list = [None] * batch.num_rows
            for at, x in _by_width(batch):
                found = index.cells(x, index.visits)
                most = 0 if index.bound is not None else max(len(c) for c in found)
                for row, cells in zip(at.tolist(), found, strict=True):
                    visits[row] = cells + cells[:1] * (most - len(cells))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("fp", "size", "width", "data")]
                + [pa.array([v[0] for v in visits], pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                names=["fp", "size", "width", "data", "home", "visits"],
            )

    def index_value():
        return index.value

    schema = "fp bigint, size bigint, width int, data binary, home bigint, visits array<bigint>"
    placed = scratch.save(nodes.select("fp", "size", "width", "data").mapInArrow(place, schema), "placed")
    living = placed.groupBy("width", F.col("home").alias("cell")).agg(F.count("*").alias("residents"))
    guests = placed.select("width", "fp", F.explode(F.array_distinct("visits")).alias("cell"))
    guests = guests.groupBy("width", "cell").agg(F.count("*").alias("visitors"))
    parts = scratch.save(
        living.join(guests, ["width", "cell"]).select(
            "width", "cell",
            F.ceil(F.col("residents") / RESIDENTS).cast("int").alias("rs"),
            F.ceil(F.col("visitors") / VISITORS).cast("int").alias("vs"),
        ),
        "parts",
    )
    told = F.lit(None).cast("array<bigint>") if bounded else F.col("visits")
    residents = (
        placed.withColumn("cell", F.col("home"))
        .join(parts, ["width", "cell"])
        .withColumn("r", F.pmod(F.hash("fp"), F.col("rs")))
        .withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
        .select("width", "cell", "r", "v", "fp", "size", "data", "home", told.alias("visits"))
    )
    visitors = (
        placed.withColumn("cell", F.explode(F.array_distinct("visits")))
        .join(parts, ["width", "cell"])
        .withColumn("v", F.pmod(F.hash("fp"), F.col("vs")))
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
        .select("width", "cell", "r", "v", "fp", "size", "data", "home")
    )
    visitors = visitors.toDF(*visitors.columns)  # columns of its own: both sides come from one table

    def compare(key, left, right):
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("fp", "links", "a", "b")})
        if not left.num_rows or not right.num_rows:
            return empty
        a, b, i, j = _block_links(left, right, cosine, int(key[0].as_py()))
        if not len(i):
            return empty
        links = np.zeros((2, max(len(a), len(b))))
        size_a, size_b = right.column("size").to_numpy(), left.column("size").to_numpy()
        np.add.at(links[0], i, size_b[j])
        np.add.at(links[1], j, size_a[i])
        counted = [(a, links[0, : len(a)]), (b, links[1, : len(b)])]
        fp = np.concatenate([n[c > 0] for n, c in counted])
        more = np.concatenate([c[c > 0] for _, c in counted]).astype(np.int64)
        one, other = _forest(a, b, i, j)
        none, nothing = pa.nulls(len(one), pa.int64()), pa.nulls(len(fp), pa.int64())
        return pa.table(
            {
                "fp": pa.chunked_array([pa.array(fp), none]), "links": pa.chunked_array([pa.array(more), none]),
                "a": pa.chunked_array([nothing, pa.array(one)]), "b": pa.chunked_array([nothing, pa.array(other)]),
            }
        )

    keys = ["width", "cell", "r", "v"]
    found = residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(
        compare, "fp bigint, links bigint, a bigint, b bigint"
    )
    found = scratch.save(found, "found")
    scratch.drop("placed")
    counts = found.where("fp IS NOT NULL").groupBy("fp").agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"), scratch, "groups").toDF("fp", "component")
    known = scratch.save(
        nodes.select("fp", "first", "size").join(counts, "fp", "left").join(groups, "fp", "left").select(
            "fp", "first", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "fp").alias("component"),
        ),
        "known",
    )
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    named = known.join(least, "component").select("fp", "n_links", "component_id")
    linked = linkable.select("vec_id", "fp").join(named, "fp").select("vec_id", "n_links", "component_id")
    alone = rows.where("fp IS NULL OR vec_id IS NULL").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
