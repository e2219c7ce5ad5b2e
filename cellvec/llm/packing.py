"""Best-fit packing of token sequences by non-negative least squares over length patterns.

Documents become pieces of at most ``max_len`` tokens. The histogram of piece lengths (at most
``max_len`` numbers) goes to the driver. There all patterns of one to three lengths that fill a
sequence are enumerated, their repeat counts fitted to the histogram by non-negative least
squares and rounded down, and what is left is packed best-fit decreasing, by counts. The plan is
a list of runs: the pieces of ranks ``start ..`` of a length go to sequences ``sequence ..`` at a
fixed offset. Its size depends on ``max_len`` alone. Ranks come from a two-level count: within
(length, salt) by a window, between salts by prefix sums, so a length that a third of all pieces
share, be they copies of one row, is dealt out over many tasks: salts hash the written pieces' row
numbers. A very long text needs some 20 times its size in memory.

Null text: empty, one piece that holds the end token. Repeated rows and ids: each row is packed.
Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import freeing
from .scratch import Scratch
from .texthash import blocks
from .tokens import END_ID, forget, token_ids, vocabulary_path

MAX_LEN = 1024
#: Pieces of one (length, salt) group.
GROUP_ROWS = 5_000
BLOCK = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, max_len: int = MAX_LEN, ranks_path: str | None = None) -> DataFrame:
    """One row per piece of every document: place and length in its ids, and their CRC."""
    path = ranks_path or vocabulary_path()
    end = np.array([END_ID], dtype="<u4")

    def cut(batches):
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                ids, bounds = token_ids(block.column("text"), path)
                doc, piece, start, length, crc = [], [], [], [], []
                for i, name in enumerate(block.column("doc_id").to_pylist()):
                    own = np.concatenate((ids[bounds[i] : bounds[i + 1]].astype("<u4", copy=False), end))
                    at, k, stop = 0, 0, (len(own) - 1) % max_len + 1
                    while at < len(own):
                        doc.append(name)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(own[at:stop].tobytes()))
                        at, k, stop = stop, k + 1, stop + max_len
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        forget(path)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(cut), PIECES)


def patterns(max_len: int) -> np.ndarray:
    """All (i, j, k), 0 <= i <= j <= k, that sum to ``max_len``; zeros stand for no document."""
    i, j = np.meshgrid(np.arange(max_len + 1), np.arange(max_len + 1), indexing="ij")
    k = max_len - i - j
    keep = (i <= j) & (j <= k)
    return np.stack([i[keep], j[keep], k[keep]], axis=1)


def fit(histogram: np.ndarray, table: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of their lengths'
    counts to the histogram: accelerated projected gradient with restarts, on the driver."""
    goal = histogram.astype(float)
    goal[0] = 0
    scale = goal.max() or 1.0
    goal = goal / scale

    def totals(x):
        out = sum(np.bincount(table[:, c], weights=x, minlength=len(goal)) for c in range(3))
        out[0] = 0
        return out

    usable = np.ones(len(table), dtype=bool)
    for c in range(3):
        usable &= (table[:, c] == 0) | (goal[table[:, c]] > 0)
    step = 1.0 / (3.0 * sum(np.bincount(table[:, c], weights=usable, minlength=len(goal)) for c in range(3))[1:].max() + 3)
    x = y = np.zeros(len(table))
    t, last = 1.0, np.inf
    for _ in range(steps):
        miss = totals(y) - goal
        loss = float(miss @ miss)
        gradient = miss[table[:, 0]] + miss[table[:, 1]] + miss[table[:, 2]]
        new = np.where(usable, np.maximum(y - step * gradient, 0), 0)
        if loss > last:
            t = 1.0
        up = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / up * (new - x)
        x, t, last = new, up, loss
    return x * scale


def best_fit(left: np.ndarray, max_len: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing of ``left[l]`` pieces of each length l, equal ones together."""
    gaps: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(max_len + 1)]
    for length in range(max_len, 0, -1):
        n = int(left[length])
        gap = length
        while n:
            while gap <= max_len and not gaps[gap]:
                gap += 1
            if gap > max_len:
                fits = max_len // length
                for many, bins in ((fits, n // fits), (n % fits, 1)):
                    if many and bins:
                        gaps[max_len - many * length][(length,) * many] += bins
                break
            held, bins = gaps[gap].popitem()
            most = gap // length
            if bins * most <= n:
                gaps[gap - most * length][held + (length,) * most] += bins
                n -= bins * most
            else:
                full, rest = divmod(n, most)
                if full:
                    gaps[gap - most * length][held + (length,) * most] += full
                if rest:
                    gaps[gap - rest * length][held + (length,) * rest] += 1
                if bins - full - bool(rest):
                    gaps[gap][held] += bins - full - bool(rest)
                n = 0
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for group in gaps:
        for held, bins in group.items():
            out[held] += bins
    return out


def plan(histogram: np.ndarray, max_len: int = MAX_LEN) -> dict[tuple[int, ...], int]:
    """How often each pattern of lengths is used; together they hold every piece once."""
    left = histogram.astype(np.int64).copy()
    used: dict[tuple[int, ...], int] = defaultdict(int)
    used[(max_len,)] = int(left[max_len])
    left[max_len] = 0
    if left.any():
        table = patterns(max_len)
        counts = fit(left, table)
        for p in np.argsort(-counts, kind="stable"):
            want = int(counts[p])
            if want < 1:
                break
            lengths = [int(v) for v in table[p] if v]
            take = min([want, *(left[v] // lengths.count(v) for v in lengths)])
            if take:
                used[tuple(lengths)] += int(take)
                for v in lengths:
                    left[v] -= take
    for lengths, n in best_fit(left, max_len).items():
        used[lengths] += n
    return {k: v for k, v in used.items() if v}


def runs(used: dict[tuple[int, ...], int], max_len: int) -> dict[str, np.ndarray]:
    """The plan as runs by (length, first rank): first sequence and offset."""
    rank = np.zeros(max_len + 1, dtype=np.int64)
    rows, sequence = [], 0
    for lengths, n in sorted(used.items(), reverse=True):
        offset = 0
        for v in lengths:
            rows.append((v, rank[v], sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "start": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack_documents(spark: SparkSession, docs: DataFrame, max_len: int = MAX_LEN, ranks_path: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence_id and offset (see the module)."""
    scratch = Scratch(spark, "pack")
    pieces = scratch.keep(token_pieces(docs, max_len, ranks_path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(max_len + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row.length] = row["count"]
    table = spark.sparkContext.broadcast(runs(plan(histogram, max_len), max_len))
    salts = F.array([F.lit(int(n) // GROUP_ROWS + 1) for n in histogram])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.get(salts, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("at", F.row_number().over(within) - 1).join(groups, ["length", "salt"])

    def place(batches):
        t = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(t["key"], (length << 48) + rank, side="right") - 1
            done = [pa.array(t["sequence"][run] + rank - t["start"][run]), pa.array(t["offset"][run])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), *done], names=[*COLUMNS, "sequence_id", "offset"])

    COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*COLUMNS, (F.col("at") + F.col("base")).alias("rank")).mapInArrow(freeing(place), f"{PIECES}, sequence_id long, offset long")
