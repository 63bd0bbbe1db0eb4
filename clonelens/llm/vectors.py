"""Embedding columns as numpy matrices, and which vectors take part at all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector is neither missing, empty, zero nor holds null or non-finite components."""
    sound = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(column, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def as_doubles(column: str = "embedding") -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def lengths(rows: DataFrame, column: str = "embedding") -> list[int]:
    """The vector lengths of a table, smallest first: one number per kind of vector."""
    return sorted(r["k"] for r in rows.select(F.size(column).alias("k")).distinct().collect())


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equally long lists of doubles as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not len(lists):
        return np.zeros((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that huge and tiny rows survive."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lists(x: np.ndarray) -> pa.Array:
    """Matrix rows as an Arrow list column."""
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))
