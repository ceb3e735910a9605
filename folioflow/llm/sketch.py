"""Arrays of fixed size that all tasks fill together: counters and set filters.

Each task fills its own array and sends the blocks it touched; blocks meet by number and a salt, so no
task gets more than a share of them. The driver receives at most one array per salt, whose size is a
parameter, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.shared import mix

_BLOCK = 4096
_SALTS = 4
_SCHEMA = "block int, salt int, data binary"


def filled(table: DataFrame, fill: Callable, size: int, dtype: type, join: np.ufunc) -> np.ndarray:
    """The array of `size` cells that fill(batches, array) makes of each task, joined by a ufunc.

    join(x, 0) must be x: blocks of zeros are not sent.
    """

    def own(batches):
        array = np.zeros(size, dtype)
        fill(batches, array)
        blocks = array.reshape(-1, min(_BLOCK, size))
        used = np.flatnonzero(blocks.any(axis=1))
        salt = int(array.sum(dtype=np.uint64) % _SALTS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)), pa.array(np.full(len(used), salt, np.int32)),
                pa.array([blocks[b].tobytes() for b in used], pa.binary()),
            ],
            names=["block", "salt", "data"],
        )

    def meet(group: pa.Table) -> pa.Table:
        values = (np.frombuffer(v.as_buffer(), dtype) for v in group.column("data"))
        total = next(values).copy()
        for value in values:
            join(total, value, out=total)
        return pa.table(
            [group.column("block")[:1], pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["block", "salt", "data"],
        )

    parts = table.mapInArrow(own, _SCHEMA).groupBy("block", "salt").applyInArrow(meet, _SCHEMA)
    out = np.zeros(size, dtype)
    for row in parts.collect():  # at most four rows a block
        values = np.frombuffer(row["data"], dtype)
        place = out[row["block"] * _BLOCK : row["block"] * _BLOCK + len(values)]
        join(place, values, out=place)
    return out


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = mix(values.view(np.uint64) + np.uint64(0x6A09E667))
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def set_filter(table: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the table's one bigint column, of 16 bits a row but at most 8 MB.

    A full filter lets everything pass: it saves shuffles and never decides a result.
    """
    bits = 1 << min(26, max(15, (16 * max(rows, 1) - 1).bit_length()))

    def fill(batches, array):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for place in _places(values.astype(np.int64), bits):
                np.bitwise_or.at(array, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    return filled(table, fill, bits // 8, np.uint8, np.bitwise_or)


def may_hold(array: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set; a value of the set always is."""
    held = np.ones(len(values), bool)
    for place in _places(values, 8 * len(array)):
        held &= (array[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    return held
