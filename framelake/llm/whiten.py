"""Whitening of vectors by the leading components of their covariance, found by contour integration (FEAST).

Sums and products of the integer entries are exact, whatever the order in which Spark adds them up. The
covariance is tridiagonalised, and Sturm sequences count its eigenvalues above any point (inertia).
Counts bracket the eigenvalues asked for and cut them into intervals at wide gaps. For each interval the
resolvent is integrated around a circle: its complex shifted solves, one for each node of the quadrature,
are Spark tasks. What they add up to spans the interval's eigenvectors, Rayleigh-Ritz extracts them, and
the interval is done when as many have converged as inertia counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import named
from .store import cut
from .vectors import finite, matrix, typical_length

#: Entries become floor(SCALE * c) + SHIFT; beyond LARGEST that is no exact integer any more.
SCALE, SHIFT, LARGEST = 1024, 100000, 1 << 42
#: Nodes on the upper half of a circle, rounds at most, and the residual that ends them, relative to the largest eigenvalue.
NODES, ROUNDS, RESIDUAL = 8, 40, 1e-13
#: Eigenvalues below this share of the largest are rank that isn't there.
RANK = 1e-13

_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- sums over all rows ------------------------------------------------------------------------


def usable(vector: str) -> Column:
    return finite(vector) & F.expr(f"not exists({vector}, e -> abs(e) >= {LARGEST}D)")


def integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, width).astype(np.float64)).astype(np.int64) + SHIFT


def _narrow(x: np.ndarray, times: int) -> np.ndarray:
    """x, as Python's integers where sums of so many of its squares might not fit into 62 bits."""
    most = max(1, int(np.abs(x).max(initial=0)))
    return x if most * most * times < 1 << 62 else x.astype(object)


def _totals(df: DataFrame, step, keys: str) -> dict:
    """Sums by key of the integers that step(batches) makes of each partition, exact in 38 digits."""
    made = df.mapInArrow(step, ", ".join(f"{k} int" for k in keys) + ", s decimal(38,0)")
    return {tuple(r[:-1]): int(r[-1]) for r in made.groupBy(*keys).agg(F.sum("s").cast("decimal(38,0)")).collect()}


def _pieces(keys: list[np.ndarray], sums: np.ndarray, names: str) -> Iterator[pa.RecordBatch]:
    if len(sums):
        yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array([int(v) for v in sums], pa.decimal128(38, 0))], names=[*names, "s"])


def sums(rows: DataFrame, width: int) -> list[int]:
    """Sum of each dimension's integers."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for b in batches:
            x = integers(b.column("v"), width)
            total = total + (x.sum(0) if np.abs(x).max(initial=0) * max(1, len(x)) < 1 << 62 else x.astype(object).sum(0))
        return _pieces([np.arange(width)], total, "i")

    found = _totals(rows, step, "i")
    return [found[(i,)] for i in range(width)]


def products(rows: DataFrame, width: int, centre: np.ndarray) -> np.ndarray:
    """(width, width) sums of products of the integers less centre, as Python's integers.

    A task adds up its rows before anything is sent: no more tasks than leave each some rows a dimension.
    """
    at = np.triu_indices(width)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width), object), False
        for b in batches:
            x = integers(b.column("v"), width) - centre
            most = int(np.abs(x).max(initial=0))
            if most * most * max(1, len(x)) < 1 << 53:
                total += np.rint(x.T.astype(float) @ x.astype(float)).astype(np.int64)
            else:
                total += x.T.astype(object) @ x.astype(object)
            seen = seen or len(x) > 0
        return _pieces([*at], total[at] if seen else [], "ij")

    found = _totals(rows, step, "ij")
    out = np.zeros((width, width), object)
    for (i, j), v in found.items():
        out[i, j] = out[j, i] = v
    return out


def covariance(rows: DataFrame, width: int, n: int) -> tuple[list[int], np.ndarray]:
    """(sums, covariance with divisor n) of the integers, each entry rounded once.

    Rows are centred at the nearest integers to the means before they are multiplied; what these are off is put right exactly.
    """
    s = sums(rows, width)
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    off = np.array([v - n * int(c) for v, c in zip(s, centre, strict=True)], object)
    top = n * products(rows.coalesce(max(1, n // (16 * width))), width, centre) - np.outer(off, off)
    return s, np.array([[float(v) for v in row] for row in top / (n * n)]) if width else np.zeros((0, 0))


# --- inertia -----------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squares beside it) of a tridiagonal matrix with the same eigenvalues, by reflections."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length > 0 and np.abs(x[1:]).max() > 0:
            x[0] += np.copysign(length, x[0])
            x /= np.linalg.norm(x)
            p = a[k + 1 :, k + 1 :] @ x
            p -= (x @ p) * x
            a[k + 1 :, k + 1 :] -= 2 * np.outer(x, p) + 2 * np.outer(p, x)
            a[k + 1, k] = a[k, k + 1] = -np.copysign(length, a[k + 1, k])
    return np.diag(a).copy(), np.square(np.diag(a, -1))


def above(diagonal: np.ndarray, squares: np.ndarray, at: float) -> int:
    """How many eigenvalues are above: the positive pivots of the matrix less `at`."""
    tiny = np.finfo(float).tiny * max(1.0, squares.max(initial=0))
    count, q = 0, 1.0
    for i, d in enumerate(diagonal):
        q = d - at - (squares[i - 1] / q if i else 0)
        q = -tiny if abs(q) < tiny else q
        count += q > 0
    return count


def eigenvalue(diagonal: np.ndarray, squares: np.ndarray, k: int) -> float:
    """The k-th largest (from 1), by halving its bracket."""
    reach = np.sqrt(np.concatenate([[0], squares])) + np.sqrt(np.concatenate([squares, [0]]))
    lo, hi = float((diagonal - reach).min()) - 1, float((diagonal + reach).max()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if above(diagonal, squares, mid) >= k else (lo, mid)
    return (lo + hi) / 2


def intervals(diagonal: np.ndarray, squares: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues within by inertia) that hold the k largest, cut where eigenvalues are far apart."""
    n = len(diagonal)
    some = [eigenvalue(diagonal, squares, i) for i in range(1, min(n, 2 * k + 8) + 1)]
    scale = max(abs(some[0]), 1e-300)
    some.append(some[-1] - 0.1 * scale)  # a border below the last one, which counts check
    last = max(range(k, len(some)), key=lambda i: some[i - 1] - some[i])
    if some[last - 1] - some[last] < 1e-9 * scale and len(some) <= n:  # no gap there: take in all
        some = [eigenvalue(diagonal, squares, i) for i in range(1, n + 1)] + [eigenvalue(diagonal, squares, n) - 0.1 * scale]
        last = n
    cuts = [some[0] + 0.05 * scale]
    first, stack = 0, [(0, last)]
    borders = set()
    while stack:
        first, end = stack.pop()
        gaps = [some[i - 1] - some[i] for i in range(first + 1, end)]
        if gaps and max(gaps) > (some[first] - some[end - 1]) / 4 and max(gaps) > 1e-6 * scale:
            at = first + 1 + int(np.argmax(gaps))
            borders.add(at)
            stack += [(first, at), (at, end)]
    cuts += [(some[i - 1] + some[i]) / 2 for i in sorted(borders)] + [(some[last - 1] + some[last]) / 2]
    counts = [above(diagonal, squares, t) for t in cuts]
    return [(b, a, m - l) for a, b, l, m in zip(cuts[:-1], cuts[1:], counts[:-1], counts[1:], strict=True) if m > l]


# --- contour integrals -------------------------------------------------------------------------


def _round(spark: SparkSession, v: np.ndarray, todo: dict[int, tuple[float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """Each interval's block of vectors, filtered by the integral of the resolvent around it: one solve for each interval and node, each its own task."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - nodes))
    plan = [(i, j) for i in todo for j in range(NODES)]
    shared = spark.sparkContext.broadcast((v, todo))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, todo = shared.value
        for frame in frames:
            out = []
            for i, j in zip(frame["interval"], frame["node"], strict=True):
                a, b, y = todo[i]
                centre, radius = (a + b) / 2, (b - a) / 2
                x = np.linalg.solve((centre + radius * turn[j]) * np.eye(len(v)) - v, y.astype(complex))
                out.append((weights[j] / 2 * (radius * turn[j] * x).real).tobytes())
            yield pd.DataFrame({"interval": frame["interval"], "node": frame["node"], "part": out})

    work = spark.createDataFrame(plan, "interval int, node int").repartition(len(plan), "interval", "node")
    parts = sorted(map(tuple, work.mapInPandas(solve, "interval int, node int, part binary").collect()), key=lambda r: r[:2])
    out = {i: np.zeros_like(y) for i, (_, _, y) in todo.items()}
    for i, _, part in parts:
        out[i] += np.frombuffer(part).reshape(out[i].shape)
    return out


def leading(spark: SparkSession, v: np.ndarray, k: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues of a symmetric matrix, or of as many as it has rank.

    Raises where fewer vectors converge in an interval than inertia counts there.
    """
    scale = float(np.abs(v).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((len(v), 0))
    v = v / scale
    t = tridiagonal(v)
    k = min(k, above(*t, RANK * eigenvalue(*t, 1)))
    rng = np.random.default_rng(seed)
    wanted = intervals(*t, k)
    block = {i: rng.standard_normal((len(v), min(len(v), 2 * m + 6))) for i, (_, _, m) in enumerate(wanted)}
    found: dict[int, np.ndarray] = {}
    spare: dict[int, int] = {}
    for _ in range(ROUNDS):
        made = _round(spark, v, {i: (*wanted[i][:2], y) for i, y in block.items()})
        for i, y in made.items():
            a, b, m = wanted[i]
            u, s, _ = np.linalg.svd(y, full_matrices=False)
            q = u[:, s > 1e-14 * s[0]]  # directions that the filter let through
            value, w = np.linalg.eigh(q.T @ v @ q)
            x = q @ w
            inside = (value > a) & (value < b)
            off = np.linalg.norm(v @ x - x * value, axis=0)
            if inside.sum() == m and off[inside].max() < RESIDUAL:
                spare[i] = spare.get(i, 0) + 1
            if spare.get(i, 0) == 2:  # one round more than it takes
                found[i] = x[:, inside]
                del block[i]
            else:
                more = rng.standard_normal((len(v), block[i].shape[1] - x.shape[1]))
                block[i] = np.hstack([x, more])
        if not block:
            break
    if block:
        raise ArithmeticError(f"eigenvectors missed in {[wanted[i] for i in block]}")
    q, _ = np.linalg.qr(np.hstack([found[i] for i in sorted(found)]))
    value, w = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-value)[:k]
    x = q @ w[:, order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)
    return value[order] * scale, x


# --- the operator ------------------------------------------------------------------------------


def whiten(df: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row its coordinates on the k leading components.

    Vectors that are null, hold null or non-finite entries or such of 2**42 and more, or have another
    length than most, are dropped. Null and repeated keys are rows like any others. There are as many
    components as the covariance has rank, so none where all vectors are alike. A deviation beyond a
    long is null. identity_error is measured on the whitened rows. Other columns don't matter.

    The driver holds the covariance, width * width numbers; rows never come together.
    """
    spark = df.sparkSession
    rows = df.select(named(key).cast("long").alias("vec_id"), named(vector).alias("v")).where(usable("v"))
    width, n = typical_length(rows, "v")
    rows = rows.where(F.size("v") == width)
    if not n or not width:
        return spark.createDataFrame([], _SCHEMA)
    total, v = covariance(rows, width, n)
    value, x = leading(spark, v, k)
    if not len(value):
        return spark.createDataFrame([], _SCHEMA)
    shared = spark.sparkContext.broadcast((np.array(total, object), x / np.sqrt(value)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, axes = shared.value
        wide = any(abs(int(s)) >= 1 << 61 for s in total)
        for b in batches:
            x = integers(b.column("v"), width)
            if wide or n * int(np.abs(x).max(initial=0)) >= 1 << 61:
                apart = n * x.astype(object) - total
            else:
                apart = n * x - total.astype(np.int64)
            squares = np.square(_narrow(apart, width) if apart.dtype != object else apart).sum(1)
            w = (apart / n).astype(float) @ axes
            fits = [int(s) if s < 1 << 63 else None for s in squares.tolist()]
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(fits, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    done = cut(rows.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    error = identity_error(done, len(value), n)
    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in value])
    out = done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(done: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of column w less the identity."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = np.hstack([matrix(b.column("w"), k), np.ones((b.num_rows, 1))])
            total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    found = np.zeros((k + 1, k + 1))
    for i, j, s in done.select("w").mapInArrow(step, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        found[i, j] = s / n
    mean = found[:k, k]
    return float(np.abs(found[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
