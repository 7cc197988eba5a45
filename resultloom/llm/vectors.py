"""Vectors of a batch as numbers: which rows hold one, and their entries in a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keep, sizes, entries) of a column of lists of numbers.

    ``keep`` marks the rows whose list is not null or empty and has no null or non-finite entry;
    ``sizes`` and ``entries`` are the lengths and, one after another, the doubles of those rows.
    """
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(pc.fill_null(column.values.cast(pa.float64()), float("nan")))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    sizes = np.diff(offsets)
    keep = np.asarray(column.is_valid()) & (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return keep, sizes[keep], flat[offsets[0] : offsets[-1]][np.repeat(keep, sizes)]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The 8-byte numbers of each row as one binary cell."""
    ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def matrix(cells: pa.Array | pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    """Binary cells of one length as the rows of a matrix."""
    rows = cells.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)
