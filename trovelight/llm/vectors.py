"""Vectors as Spark rows and as NumPy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows whose vector is not null, not empty, and finite throughout."""
    number = F.col("vector")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return picked.where(F.col("key").isNotNull() & number.isNotNull() & (F.size(number) > 0) & finite)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)
