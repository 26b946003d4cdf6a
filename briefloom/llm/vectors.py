"""Vectors of an embedding column as integers, for operators that compute exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: Column) -> Column:
    """Whether a vector is there, with no null, infinite or undefined entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vector: Column, limit: int, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry as a bigint, held within ±limit."""
    return F.transform(vector, lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(c.cast("double") * scale))).cast("bigint"))


def padded(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """rows with all vectors of the longest one's length, by zeros at the end; and that length (one pass over the column)."""
    d = rows.agg(F.max(F.size(column))).first()[0] or 0
    return rows.withColumn(column, F.concat(column, F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size(column)))), d


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow vectors of one length as rows of int64."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(array)
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def matrices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 4096) -> Iterator[np.ndarray]:
    """A column of vectors in matrices of at most so many rows."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield matrix(batch.column(column).slice(at, rows))
