"""Columns of vectors: which rows can be computed with, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither nulls nor NaN nor infinities."""
    return F.expr(f"{vector} is not null and not exists({vector}, e -> e is null or isnan(e) or abs(e) = double('infinity'))")


def typical_length(df: DataFrame, vector: str) -> tuple[int, int]:
    """(length, rows of it) that most vectors have, of equals the larger; (0, 0) without rows."""
    by = df.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    first = by.orderBy(F.desc("n"), F.desc("size")).first()
    return (first["size"], first["n"]) if first else (0, 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of one length as (rows, width)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """As a column of arrays again."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(x).ravel(), kind))
