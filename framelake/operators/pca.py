"""Principal components of wide rows by block subspace iteration: products are summed on Spark, the driver holds a thin block.

Each round multiplies the covariance with a block, its residuals and the block before, and takes the best block of their span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.frames import byte_matrix
from .resample import matrix

#: Directions beyond those asked for, rounds at most, and the relative change of the variances that ends them.
EXTRA, ROUNDS, SETTLED = 6, 60, 1e-13
#: Rows are sent on in pieces of so many values.
PIECE = 4096


def _rows(column: pa.Array) -> np.ndarray:
    """(rows, values) of a column of arrays of one length, or of binaries with a byte a value."""
    return (byte_matrix(column) if pa.types.is_binary(column.type) else matrix(column)).astype(float)


def _summed(df: DataFrame, column: str, width: int, step) -> np.ndarray:
    """(width, k) sums over all rows of step((rows, values) of a batch): each task adds up its own, then equal pieces are added up side by side."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                total = total + step(_rows(b.column(column).slice(i, 1024)))
        if isinstance(total, np.ndarray):
            flat = total.ravel()
            at = range(0, len(flat), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int64()), pa.array([flat[i : i + PIECE] for i in at], pa.list_(pa.float64()))], names=["at", "part"])

    parts = df.select(column).mapInArrow(add, "at long, part array<double>")
    each = parts.select("at", F.posexplode("part").alias("i", "v")).groupBy("at", "i").agg(F.sum("v").alias("v"))
    got = each.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("part")).select("at", F.transform("part", lambda x: x["v"]).alias("part"))
    rows = sorted(map(tuple, got.collect()))  # width x k numbers
    return np.concatenate([np.zeros(0), *[np.array(p) for _, p in rows]]).reshape(width, -1)


def principal(df: DataFrame, column: str, k: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, components as columns, their variances, total variance) of a column of arrays, or of binaries with a byte a value, by falling variance.

    Rows are centred before they are multiplied. A component's sign is that of its largest entry, which is
    positive. There are fewer than k where rows are fewer or vary in fewer directions.
    """
    rows = df.where(F.col(column).isNotNull())
    size = F.length if dict(df.dtypes)[column] == "binary" else F.size
    first = rows.select(size(column).alias("width")).first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0
    width = first["width"]
    sums = _summed(rows, column, width + 1, lambda x: np.vstack([x.sum(0)[:, None], [[len(x)]]]))
    n, mean = sums[-1, 0], sums[:-1, 0] / sums[-1, 0]
    spark = df.sparkSession
    block = min(width, k + EXTRA)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, block)))
    x, before = q, np.zeros(k)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((mean, q))

        def product(x: np.ndarray, shared=shared) -> np.ndarray:
            mean, q = shared.value
            centred = x - mean
            return np.hstack([centred.T @ (centred @ q), np.square(centred).sum(0)[:, None]])

        y = _summed(rows, column, width, product) / n
        shared.destroy()
        total, y = float(y[:, -1].sum()), y[:, :-1]
        value, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)  # Rayleigh-Ritz: the basis's own axes
        value, turn = value[::-1][:block], turn[:, ::-1][:, :block]
        last, x, off = x, q @ turn, y @ turn - (q @ turn) * value
        settled = np.abs(value[:k] - before[: len(value[:k])]).max(initial=0) <= SETTLED * max(total, 1e-300)
        before = value[:k]
        if settled:
            break
        u, s, _ = np.linalg.svd(np.hstack([x, off / np.maximum(np.linalg.norm(off, axis=0), 1e-300), last]), full_matrices=False)
        q = u[:, s > 1e-8 * s[0]]  # the block, where it wants to go, and where it comes from
    kept = int((before > 1e-12 * max(total, 1e-300)).sum())
    axes = x[:, :kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(kept)] < 0, -1, 1) if kept else axes
    return mean, axes, before[:kept], total


def project(df: DataFrame, column: str, out: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """df with out: each row's coordinates on the components."""
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for b in batches:
            if b.num_rows:
                x = (_rows(b.column(column)) - mean) @ axes
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(list(x), pa.list_(pa.float64()))], names=[*kept, out])

    return df.where(F.col(column).isNotNull()).mapInArrow(step, schema)
