"""Arrow list columns as numpy matrices and batches in small slices, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equally long number lists as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    width = len(lists[0]) if len(lists) else 0
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.astype(float, copy=False).reshape(len(lists), width)


def packed_rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes, which Spark moves whole and not number by number."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, dtype=float))])


def unpacked_rows(column: pa.Array) -> np.ndarray:
    """The matrix of ``packed_rows``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(offsets[0]) : int(offsets[-1])], float).reshape(len(column), -1)


# What a task turns into Python objects at a time; sessions may send 10,000 texts in one batch.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def text_slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows and SLICE_BYTES of ``column``; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            most = int(ends[at] - sizes[at]) + SLICE_BYTES
            to = min(max(int(np.searchsorted(ends, most, side="right")), at + 1), at + SLICE_ROWS)
            yield batch.slice(at, to - at)
            at = min(to, batch.num_rows)


ROWS = "at int, v array<double>"


def row_sums(values: np.ndarray) -> pa.RecordBatch:
    """A task's partial sum of a matrix, one output row per matrix row."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(float)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), lists], names=["at", "v"])


def added_up(parts: DataFrame, height: int, width: int) -> np.ndarray:
    """The tasks' partial sums added in Spark; the result is one ``height`` x ``width`` matrix."""
    total = parts.groupBy("at").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    out = np.zeros((height, width))
    for row in total.collect():
        out[row["at"]] = row["v"].toArray()
    return out
