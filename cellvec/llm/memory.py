"""What a Python worker gives back between stages: workers live on, and what one stage took the next can't use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import texthash


def release() -> None:
    """Drop what was kept for speed and return freed memory to the system, where it knows how."""
    texthash.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freeing(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, a function of batches, that leaves its worker as small as it can."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run
