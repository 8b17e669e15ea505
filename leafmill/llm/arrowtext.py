"""Arrow text columns as numpy code-point arrays, and mapInArrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values joined, offsets of the n+1 value bounds). A null counts as empty text.

    One decode for the whole batch; no per-row string calls.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    low, high = int(bounds[0]), int(bounds[-1])
    if low == high:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8, high - low, low)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, bounds - low
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, starts[bounds - low]


def to_strings(points: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of code_points; valid marks the values that are not null."""
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(data) == len(points):
        offsets = bounds.astype(np.int64)
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.concatenate(([0], np.cumsum(width)))[bounds]
    out = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    if valid is not None and not valid.all():
        out = pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


#: Rows handed to an operator at once; with whole texts this bounds its arrays.
ROWS = 512


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """df through fn, at most ROWS rows at a time. fn may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                if (out := fn(batch.slice(at, ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)
