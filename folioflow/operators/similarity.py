"""Exact filtered top-n by cosine similarity for a whole table of queries.

Scoring is a matrix product inside Arrow batches. Queries are taken in passes of bounded size,
grouped by their filter values; a pass is sent to all tasks and the chunk table is scanned, so no
vector of it moves, and only rows that a group's filters admit are multiplied with its queries.

Each task keeps its best ``n`` rows per query. Where the tasks would send many rows, a few of them are
scanned first: the ``n``-th score they give for a query is a lower bound of its final one, and is
sent along with the query to the next, larger round, in which only rows that reach it are kept. So
what is shuffled per query is bounded by ``n`` and the growth from round to round, not by the tasks.

Rows are ranked by scores on SCORE_DECIMALS places, callers round them for output; ties are
broken by id, which makes the cut at ``n`` deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.operators.lineage import materialise

BLOCK_QUERIES = 4096
#: One pass over the table takes as many queries as hold this many components, and ask for this many rows.
PASS_CELLS = 1_572_864
PASS_ROWS = 524_288
#: Bounds from earlier rounds are fetched only where all tasks together might send more rows than this.
SENT_ROWS = 16_000_000
#: A round scans this many times the tasks of the round before; the first one as many tasks at most.
GROWTH = 16
SCORE_DECIMALS = 12
MERGE_SLICES = 16  # first-level merge groups per query
_TILE_CELLS = 1_000_000  # scores held at once by one task
_WAITING = 1_000_000  # rows that a task lays aside before it merges them
_SAMPLE = 512  # rows that give a query its first bound
_SLACK = 1e-11  # more than rounding to SCORE_DECIMALS moves a score


@dataclass(frozen=True)
class _Block:
    """A bounded set of query variants in array form, shipped to tasks."""

    keys: np.ndarray  # position -> query row
    limits: np.ndarray
    vectors: np.ndarray  # (queries, dim), unit length
    groups: list[tuple[dict[str, object], np.ndarray]]  # wanted filter values, positions that want them
    floors: np.ndarray  # scores below can be no winners
    tile: int  # queries multiplied with a batch at once


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    norms[norms == 0] = 1.0
    return rows / norms[:, None]


def _searchable(column, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a finite vector of the width (None: of any, as long as it is one), and those.

    Other rows are left out of a search: a null vector, a null or non-finite component, or a vector
    of another length has no cosine with a query. ``embedding.vector_width`` reports them.
    """
    if isinstance(column, (pa.ListArray, pa.LargeListArray)):
        lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    else:
        lengths = np.array([-1 if v is None else len(v) for v in column], dtype=np.int64)
    if width is None:
        widths = np.unique(lengths)
        if len(widths) > 1 or widths[0] < 1:
            raise ValueError("the queries of a search need vectors of one width")
        width = int(widths[0])
    keep = lengths == width
    if isinstance(column, (pa.ListArray, pa.LargeListArray)):
        flat = column.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False)
    else:
        chosen = [np.asarray(v, dtype=np.float64) for v, k in zip(column, keep) if k]
        flat = np.concatenate(chosen) if chosen else np.zeros(0)
    vectors = flat.reshape(-1, width)
    finite = np.isfinite(vectors.astype(np.float64)).all(axis=1)
    keep[keep] = finite
    return keep, vectors[finite]


class _Best:
    """Running best rows of all queries: winners of a batch wait and are merged together."""

    def __init__(self, block: _Block, carry: Sequence[str]) -> None:
        self.block = block
        self.carry = list(carry)
        self.floors = np.where(block.limits > 0, block.floors, np.inf)
        # queries that hold their n rows, and the id of the last of these
        self.full = np.zeros(len(block.keys), dtype=bool)
        self.ends = np.zeros(len(block.keys), dtype=object)
        # positions of queries, scores, ids and one array per carried column; by query, best first
        self.rows: list[np.ndarray] = []
        self.waiting: list[list[np.ndarray]] = []

    def add(self, ids: np.ndarray, embeddings, values: dict[str, np.ndarray]) -> None:
        if not len(ids) or not len(self.block.keys):
            return
        keep, vectors = _searchable(embeddings, self.block.vectors.shape[1])
        ids, values = ids[keep], {name: column[keep] for name, column in values.items()}
        if not len(ids):
            return
        unit = _unit(vectors)
        columns = [ids] + [values[c] for c in self.carry]
        codes = {name: pd.factorize(values[name]) for name in {f for wanted, _ in self.block.groups for f in wanted}}
        for wanted, positions in self.block.groups:
            rows = np.arange(len(ids))
            for name, value in wanted.items():
                have, levels = codes[name]
                code = np.flatnonzero(np.asarray(levels, dtype=object) == value)
                rows = rows[have[rows] == code[0]] if len(code) else rows[:0]
            if not len(rows):
                continue
            some = unit if len(rows) == len(unit) else unit[rows]
            tile = min(self.block.tile, max(1, _TILE_CELLS // len(rows)))
            for at in range(0, len(positions), tile):
                part = positions[at : at + tile]
                self._hits(part, self.block.vectors[part] @ some.T, columns, rows)
        self._settle()

    def _hits(self, part: np.ndarray, scores: np.ndarray, columns: list[np.ndarray], take: np.ndarray) -> None:
        """Lay aside what can still win; only these scores are rounded."""
        self._bound(part, scores)
        floors = self.floors[part]
        q, row = np.divmod(np.flatnonzero(scores >= (floors - _SLACK)[:, None]), scores.shape[1])
        scores = np.round(scores[q, row], SCORE_DECIMALS) + 0.0  # no negative zero
        hopeful = scores >= floors[q]
        level = np.flatnonzero(hopeful & self.full[part][q] & (scores == floors[q]))
        if len(level):  # as good as the last row held: the smaller id stays
            hopeful[level] = columns[0][take[row[level]]] < self.ends[part[q[level]]]
        if hopeful.any():
            row = take[row[hopeful]]
            self.waiting.append([part[q[hopeful]], scores[hopeful]] + [c[row] for c in columns])
            if sum(len(w[0]) for w in self.waiting) > _WAITING:
                self._settle()

    def _bound(self, part: np.ndarray, scores: np.ndarray) -> None:
        """First lower bounds: the n-th scores among the first rows that a query meets."""
        unbound = np.flatnonzero(self.floors[part] == -np.inf)
        limits = self.block.limits[part[unbound]]
        for n in np.unique(limits).tolist():
            seen = min(scores.shape[1], max(_SAMPLE, 4 * n))
            if seen >= n:
                places = unbound[limits == n]
                best = np.partition(scores[places, :seen], seen - n, axis=1)[:, seen - n]
                self.floors[part[places]] = np.round(best, SCORE_DECIMALS) + 0.0

    def _settle(self) -> None:
        """Merge what waits into the best rows, and raise the bounds of the queries that hold ``n``."""
        if not self.waiting:
            return
        pieces = [self.rows, *self.waiting] if self.rows else self.waiting
        self.waiting = []
        columns = [np.concatenate(c) for c in zip(*pieces, strict=True)]
        query, score, ids = columns[:3]
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        limits = self.block.limits[query]
        self.rows = [c[order[place < limits]] for c in columns]
        last = order[place == limits - 1]
        held = columns[0][last]
        self.full[held] = True
        self.floors[held] = np.maximum(self.floors[held], score[last])
        self.ends[held] = ids[last]

    def table(self) -> dict[str, list]:
        if not self.rows:
            return {name: [] for name in ("variant", "n", "score", "id", *self.carry)}
        query, score, *columns = self.rows
        out = {
            "variant": self.block.keys[query].tolist(),
            "n": self.block.limits[query].tolist(),
            "score": score.tolist(),
        }
        return out | {name: c.tolist() for name, c in zip(["id", *self.carry], columns, strict=True)}


def _query_vectors(rows: pd.DataFrame) -> np.ndarray:
    if not len(rows):
        return np.zeros((0, 1))
    keep, vectors = _searchable(rows["embedding"])
    if not keep.all():
        raise ValueError("the queries of a search need finite vectors")
    return _unit(vectors)


def _query_block(rows: pd.DataFrame, filter_columns: Sequence[str], tile: int = BLOCK_QUERIES) -> _Block:
    groups: dict[tuple, list[int]] = {}
    for place, values in enumerate(zip(*(rows[f] for f in filter_columns), strict=True) if filter_columns else [()] * len(rows)):
        groups.setdefault(tuple(None if pd.isna(v) else v for v in values), []).append(place)
    return _Block(
        keys=rows["variant"].to_numpy(dtype=np.int64),
        limits=rows["n"].to_numpy(dtype=np.int64),
        vectors=_query_vectors(rows),
        groups=[
            ({f: v for f, v in zip(filter_columns, wanted, strict=True) if v is not None}, np.array(places))
            for wanted, places in groups.items()
        ],
        floors=np.full(len(rows), -np.inf),
        tile=tile,
    )


def _ids(column) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    if values and isinstance(values[0], str):
        return np.array(values, dtype=object)
    return np.array(values)


def _pushed_filters(block_rows: pd.DataFrame, filter_columns: Sequence[str]):
    """Filters every query agrees to carry, as scan predicates."""
    for name in filter_columns:
        wanted = block_rows[name]
        if len(wanted) and wanted.notna().all():
            yield F.col(name).isin(*sorted(set(wanted)))


def _passes(asked: DataFrame, filter_columns: Sequence[str], block: int, most: int | None) -> Iterator[pd.DataFrame]:
    """The queries by passes over the table, each of one block or more; equal filter values side by side."""
    first = asked.limit(block + 1).toArrow().to_pandas()
    if len(first) <= block:
        yield first
        return
    asked = materialise(asked)
    count, n, width = asked.agg(F.count("*"), F.max("n"), F.max(F.size("embedding"))).first()
    if most is None:
        most = max(block, min(PASS_ROWS // max(n, 1), PASS_CELLS // max(width, 1)))
    ranges = ceil(count / most)
    placed = materialise(
        asked.repartitionByRange(ranges, *filter_columns, "variant").withColumn("range", F.spark_partition_id())
    )
    for place in range(ranges):
        rows = placed.filter(F.col("range") == place).drop("range").toArrow().to_pandas()
        for at in range(0, len(rows), most):
            yield rows.iloc[at : at + most].reset_index(drop=True)


def _tasks(side: DataFrame) -> int:
    """About how many tasks scan the stored tables under ``side``; what a join may make of them does not count."""
    leaves = side._jdf.queryExecution().optimizedPlan().collectLeaves()
    conf = side.sparkSession._jsparkSession.sessionState().conf()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < conf.defaultSizeInBytes())
    return known // conf.filesMaxPartitionBytes()


def _strides(tasks: int, rows: int) -> list[int]:
    """Which tasks the rounds before the full one scan: every so-many-th; ``rows`` is what a task may send."""
    out: list[int] = []
    while tasks > GROWTH and tasks * rows > SENT_ROWS:
        out.append(GROWTH ** (len(out) + 1))
        tasks //= GROWTH
    return out[::-1]


def top_n(
    chunks: DataFrame,
    queries: DataFrame,
    *,
    id_column: str = "chunk_id",
    query_column: str = "query_id",
    n_column: str = "n",
    filter_columns: Sequence[str] = (),
    carry: Sequence[str] = (),
    block_queries: int = BLOCK_QUERIES,
    strides: Sequence[int] | None = None,
    pass_queries: int | None = None,
) -> DataFrame:
    """Best ``n`` chunks per query: (query_column, id_column, score, carried columns…).

    ``queries`` rows are (query_column, n_column, embedding, filter columns…); a null
    filter value means no restriction. One query id may appear several times with other
    filters if the caller makes the id unique first. ``carry`` names short text columns of
    ``chunks`` that ride along, which saves a second pass over the chunk table. ``block_queries`` are
    multiplied with a batch at once; the table is read once a pass, of one block or more, and in parts
    for the bounds where tasks would send many rows: store what is costly to compute before a search of
    several passes. ``strides`` overrides which tasks the rounds before the full one scan, and
    ``pass_queries`` how many queries a pass takes.
    """
    id_type = chunks.schema[id_column].dataType
    asked = queries.select(
        F.col(query_column).alias("variant"),
        F.col(n_column).cast("int").alias("n"),
        F.col("embedding"),
        *filter_columns,
    )
    side = chunks.select(
        F.col(id_column).alias("id"), "embedding", *dict.fromkeys([*filter_columns, *carry])
    )
    out = T.StructType(
        [
            T.StructField("variant", T.LongType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("id", id_type),
            *[T.StructField(c, T.StringType()) for c in carry],
        ]
    )
    tasks = _tasks(side) if strides is None else 0
    found, last = [], None
    for rows in _passes(asked, filter_columns, block_queries, pass_queries):
        if last is not None:
            found.append(materialise(last))  # small; frees the queries before the next ones are sent
        rounds = _strides(tasks, int(rows["n"].sum())) if strides is None else strides
        last = _search(side, rows, filter_columns, carry, out, rounds, block_queries)
    merged = reduce(DataFrame.unionByName, found, last)
    return merged.select(
        F.col("variant").alias(query_column), F.col("id").alias(id_column), "score", *carry
    )


def _search(
    side: DataFrame,
    rows: pd.DataFrame,
    filter_columns: Sequence[str],
    carry: Sequence[str],
    out: T.StructType,
    rounds: Sequence[int],
    tile: int,
) -> DataFrame:
    """The best rows of one pass's queries, after the rounds that give its lower bounds."""
    for predicate in _pushed_filters(rows, filter_columns):
        side = side.filter(predicate)
    block = _query_block(rows, filter_columns, tile)
    most = int(rows["n"].max()) if len(rows) else 0
    place = {int(k): i for i, k in enumerate(block.keys)}
    for stride in rounds:
        ends = _merge(_scan(side, block, carry, out, stride), most).groupBy("variant", "n").agg(
            F.count("*").alias("held"), F.min("score").alias("last")
        )
        for end in ends.filter("held >= n").collect():  # at most a row a query of the pass
            q = place[end["variant"]]
            block.floors[q] = max(block.floors[q], end["last"])
    return _merge(_scan(side, block, carry, out, 1), most).drop("n")


def _scan(side: DataFrame, block: _Block, carry: Sequence[str], out: T.StructType, stride: int) -> DataFrame:
    """Winners of every ``stride``-th task."""
    sent = side.sparkSession.sparkContext.broadcast(block)
    names = [c for c in side.columns if c not in ("id", "embedding")]
    carried = list(carry)
    shape = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % stride:
            return
        best = _Best(sent.value, carried)
        for batch in batches:
            best.add(
                _ids(batch.column("id")),
                batch.column("embedding"),
                {f: np.array(batch.column(f).to_pylist(), dtype=object) for f in names},
            )
        yield pa.RecordBatch.from_pydict(best.table(), schema=shape)

    return side.mapInArrow(scan, out)


def _merge(partial: DataFrame, most: int) -> DataFrame:
    """Task winners to query winners in two levels, so one busy query spreads over
    ``MERGE_SLICES`` tasks before its final, small ranking."""
    ranked = partial.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(MERGE_SLICES)))
    order = (F.col("score").desc(), F.col("id"))
    for keys in (("variant", "slice"), ("variant",)):
        w = Window.partitionBy(*keys).orderBy(*order)
        # the literal bound lets Spark prune inside the map side of the shuffle
        ranked = (
            ranked.withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= F.lit(most))
            .filter(F.col("place") <= F.col("n"))
        )
    return ranked.drop("slice", "place")
