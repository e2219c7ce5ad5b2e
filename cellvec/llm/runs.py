"""Runs of letters of whole Arrow batches of text, numbered by their distinct spellings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .texthash import flat

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(texts: pa.Array, inside: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Maximal runs of the bytes that are ``inside``, with A-Z lowered: the number of each run's spelling, the
    spellings, and for each text the place of its first run (one more at the end)."""
    data, offsets = flat(texts)
    keep = inside(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, stop = keep.copy(), keep.copy()
    start[1:] &= ~keep[:-1] | edge[1:-1]
    stop[:-1] &= ~keep[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(stop) + 1 - starts, out=ends[1:])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(LOWER[data[keep]])).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.searchsorted(starts, offsets)


def by_text(numbers: np.ndarray, first: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, times) of the distinct numbers of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    both, times = np.unique(text * kinds + numbers, return_counts=True)
    return both // max(kinds, 1), both % max(kinds, 1), times
