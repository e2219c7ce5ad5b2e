"""Counts and bitmaps of hashes by cell: tables of bounded size over all rows, however many there are.

A cell's count is never below the count of any hash in it, and a bitmap has the cell of every hash
in it. Counts serve to order by rarity; bitmaps leave out rows that can't join. Both only save work:
a full table orders by hash and lets every row through, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import freeing
from .texthash import mix

#: Bits of the largest bitmap (a byte a cell in tasks, a bit in broadcasts) and its cells for each hash.
MOST_BITS, ROOM = 26, 16


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def add_up(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, once: bool) -> np.ndarray:
    """Counts by cell, or marks of the cells met (``once``).

    Each task fills an array of 2**bits; chunks of these, the used ones, are added in a shuffle, one row a
    chunk and task, streamed; the driver gets the 2**bits sums.
    """
    size = 1 << bits
    chunk_cells = max(64, size >> 10)
    width = chunk_cells // 8

    def pack(row):
        if once:
            return np.packbits(row).tobytes()
        return row.astype(np.uint16 if row.max() <= 0xFFFF else np.int64).tobytes()

    def unpack(raw):
        if len(raw) == width:
            return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * chunk_cells else np.int64).astype(np.int64)

    def rows(grid, used):
        for i in range(0, len(used), 128):
            some = used[i : i + 128]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pack(grid[k]) for k in some], pa.binary())], names=["chunk", "held"])

    def fill(batches):
        total = np.zeros(size, dtype=bool if once else np.int64)
        for batch in batches:
            for h in hashes(batch):
                if once:
                    total[cell_of(h, bits)] = True
                else:
                    np.add.at(total, cell_of(h, bits), 1)
        grid = total.reshape(-1, chunk_cells)
        yield from rows(grid, np.flatnonzero(grid.any(axis=1)))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = unpack(raw)
                sums[chunk] = sums[chunk] + row if chunk in sums else row
        yield from rows(sums, list(sums))

    schema = "chunk long, held binary"
    out = np.zeros((size // chunk_cells, chunk_cells), dtype=bool if once else np.int64)
    for row in df.mapInArrow(freeing(fill), schema).repartition("chunk").mapInArrow(freeing(add), schema).collect():
        out[row.chunk] = unpack(row.held)
    return out.reshape(-1)


def count_cells(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Rows by the first ``bits`` bits of their hashes (``hashes`` gives 64-bit arrays for a batch)."""
    return add_up(df, hashes, bits, False)


class Bitmap:
    """Cells of a column of 64-bit numbers; sized by their number, up to 2**MOST_BITS cells."""

    def __init__(self, df: DataFrame, column: str):
        n = df.count()
        self.bits = int(np.clip(np.ceil(np.log2(max(1, n) * ROOM)), 12, MOST_BITS))

        def hashes(batch):
            yield mix(batch.column(0).to_numpy().view(np.uint64))

        self.table = df.sparkSession.sparkContext.broadcast(np.packbits(add_up(df.select(column), hashes, self.bits, True)))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        cell = cell_of(mix(numbers), self.bits)
        return ((self.table.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose long ``column`` may be among the first column of ``ids``: all that are, few others."""
    held = Bitmap(ids, ids.columns[0])

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(held.has(batch.column(column).to_numpy().view(np.uint64))))

    return df.filter(F.col(column).isNotNull()).mapInArrow(freeing(keep), df.schema)
