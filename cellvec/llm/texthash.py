"""Vectorised hashing of words and shingles over whole Arrow batches of text.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. A word's hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; shingle hashes
combine word hashes. Two different 64-bit hashes always mean different text; equal ones mean
equal text but for a chance of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([(BASE * (2 * i + 3) ** 5 * 2 + 1) & (2**64 - 1) for i in range(16)], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
LOWER += np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        _powers[base] = got = np.cumprod(got, dtype=np.uint64)
    return got


def forget_powers() -> None:
    _powers.clear()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text at most, or of one row, so that temporary arrays stay small."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and, for each text, the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LOWER[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    h = (total[stops] - total[starts]) * powers(BASE_INVERSE, len(data))[starts]
    h += (stops - starts).astype(np.uint64) * PLACES[15]
    return mix(h), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as its one shingle, a text without words none.
    """
    n = len(h) - width + 1
    if n > 0:
        full = h[:n] * PLACES[0]
        for k in range(1, width):
            full += h[k : k + n] * PLACES[k]
        full = mix(full)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        elif b > a:
            one = (h[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            yield mix(one * PLACES[14])
        else:
            yield np.zeros(0, np.uint64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common numbers of two sorted arrays of distinct ones."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # merges the two runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


def sequence_digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's sequence of words."""
    out = []
    for base in (PLACES[12], PLACES[13]):
        base = int(base)
        inverse = pow(base, -1, 1 << 64)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(base, len(h))[: len(h)], out=total[1:])
        a, b = first[:-1], first[1:]
        d = (total[b] - total[a]) * powers(inverse, len(h))[a] + (b - a).astype(np.uint64)
        out.append(mix(d))
    return out[0], out[1]


def signed(x: np.ndarray) -> np.ndarray:
    """Spark has signed longs only."""
    return x.view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of one array a row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat_values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_values, type=kind))
