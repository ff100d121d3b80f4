"""Text columns of Arrow batches, in row ranges of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ranges(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most so many bytes, or one row where that row is longer."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and wait beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
