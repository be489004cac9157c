"""Arrow text columns as groups of byte strings of bounded size, for vectorised numpy passes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19


def byte_groups(column, limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) for runs of rows of at most ``limit`` bytes; a longer text comes alone.
    Null counts as empty."""
    rows = pc.fill_null(column.cast(pa.string()), "").cast(pa.binary())
    sizes = pc.binary_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    first = 0
    while first < len(sizes):
        upto = np.searchsorted(np.cumsum(sizes[first:first + 100_000]), limit, side="right")
        last = first + max(1, int(upto))
        yield first, rows.slice(first, last - first).to_pylist()
        first = min(last, len(sizes))


def joined(texts: list[bytes], pad: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with ``pad`` before and after each as one array, and where each padded text starts and ends."""
    buf = np.frombuffer(b"".join([pad + t + pad for t in texts]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 2 * len(pad) for t in texts), np.int64, len(texts)))
    return buf, np.concatenate(([0], ends[:-1])), ends


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[i]:ends[i]]`` for adjacent or separated ascending segments; empty ones give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:], dtype=np.float64)
    return total[ends] - total[starts]


def small_batches(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that the executor holds few rows of a wide result at a time."""
    for a in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(a, rows)


def tidy(run):
    """``run`` for ``mapInArrow``, giving freed memory back to the system when a task ends: Python workers live on from stage to
    stage, and what their allocators hoard would add up beside the executor's heap."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass
    return wrapped
