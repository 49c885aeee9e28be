"""Columns of vectors: which can be used, how long they are, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers; never null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def common_length(df: DataFrame, vec_col: str) -> int:
    """The most frequent length of the finite vectors, the greater of two as frequent; 0 if there are none."""
    lengths = df.where(is_finite(F.col(vec_col))).groupBy(F.size(vec_col).alias("length")).count()
    found = lengths.orderBy(F.desc("count"), F.desc("length")).head()
    return found["length"] if found else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A batch of finite vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def from_bytes(column: pa.Array, kind, length: int) -> np.ndarray:
    """The rows that a binary column holds, as a matrix; ``length`` numbers of ``kind`` each."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), length) if data else np.zeros((len(column), length), kind)


def summed_cells(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial matrices that tasks give as rows (cell, value); only sums of ``shape`` reach the driver."""
    total = np.zeros(shape[0] * shape[1])
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    return total.reshape(shape)


def as_cells(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])
