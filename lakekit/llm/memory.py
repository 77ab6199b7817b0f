"""Memory of Python workers, which outlive their tasks.

A worker serves one task after another, whatever query they belong to, and its allocators keep what a task has freed. Beside
an executor whose heap is full, that rest of earlier stages is what the next one lacks, so each batch or group gives it back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError, TypeError):  # another C library than glibc

    def _trim(_: int) -> int:
        return 0


def tidy(function: Callable, *args):
    """``function(*args)``; the memory that it has freed goes back to the machine."""
    try:
        return function(*args)
    finally:
        pa.default_memory_pool().release_unused()
        _trim(0)


def each(function: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator:
    """``function`` of every batch, tidily."""
    for batch in batches:
        yield tidy(function, batch)
    batch = None  # the last one, too
    tidy(lambda: None)
