"""Tiles of frames that are held whole, a frame a row: cropped, widened, worked on and stitched in Arrow batches.

What a frame's tiles need of each other stands in its own row, so nothing is shuffled but sums.
tiling.py does the same over rows of pixels, which may come from anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.frames import byte_matrix


def starts(n: int, size: int) -> list[int]:
    """Where tiles begin along an axis; the last one is shifted inside."""
    return [max(0, min(at, n - size)) for at in range(0, n, size)]


def cut(frames: np.ndarray, size: int) -> np.ndarray:
    """(n, rows, columns, size, size) tiles of (n, h, w) frames."""
    ys, xs = (starts(n, size) for n in frames.shape[1:])
    return np.stack([np.stack([frames[:, y : y + size, x : x + size] for x in xs], 1) for y in ys], 1)


def lay(tiles: np.ndarray, h: int, w: int, order: str = "column", scale: int = 1) -> np.ndarray:
    """(n, h, w) frames of tiles as cut() gives them, enlarged by scale; where tiles overlap the last in write order wins."""
    size = tiles.shape[3]
    ys, xs = (starts(n, size // scale) for n in (h, w))
    out = np.empty((len(tiles), h * scale, w * scale), tiles.dtype)
    places = [(i, j) for j in range(len(xs)) for i in range(len(ys))] if order == "column" else [(i, j) for i in range(len(ys)) for j in range(len(xs))]
    for i, j in places:
        y, x = ys[i] * scale, xs[j] * scale
        out[:, y : y + size, x : x + size] = tiles[:, i, j]
    return out


def cut_wide(frames: np.ndarray, size: int, halo: int) -> np.ndarray:
    """Tiles as cut() gives them with halo pixels on each side, the frame's outermost pixels repeated; sides are multiples of size."""
    p = np.pad(frames, ((0, 0), (halo, halo), (halo, halo)), mode="edge")
    rows, columns = frames.shape[1] // size, frames.shape[2] // size
    wide = size + 2 * halo
    return np.stack([np.stack([p[:, i * size : i * size + wide, j * size : j * size + wide] for j in range(columns)], 1) for i in range(rows)], 1)


def box_sum(wide: np.ndarray, k: int = 3) -> np.ndarray:
    """Sums over k x k pixels of each tile, of tiles widened by k // 2."""
    n = wide.shape[-1] - k + 1
    return sum(wide[..., dy : dy + n, dx : dx + n].astype(np.int32) for dy in range(k) for dx in range(k))


def linear(kernel: Callable[[np.ndarray], np.ndarray], n: int, unit: int = 1) -> np.ndarray:
    """The matrix of a kernel that is linear in its n pixels, in floats; products with bytes are exact while sums stay below 2**24."""
    return kernel(np.eye(n, dtype=np.int64) * unit).astype(np.float32)


def digested(frames: DataFrame, keys: list[str], h: int, w: int, kernel: Callable[[np.ndarray], np.ndarray], shift: str | None = None, batch: int = 512) -> DataFrame:
    """(keys, n, v_sum, v_mix) of what kernel makes of frames (keys, luma: h * w bytes): number, sum and place-weighted sum of its values.

    shift names a key that is added to each place of its frame. One row a frame leaves Python.
    """
    schema = T.StructType([*[frames.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("n", "v_sum", "v_mix")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                made = kernel(byte_matrix(b.column("luma")).reshape(-1, h, w))
                if weights is None:
                    place = (np.arange(made.shape[1])[:, None] * 37 + np.arange(made.shape[2]) * 101).ravel() % 97
                    weights = ((place + np.arange(97 if shift else 1)[:, None]) % 97).astype(np.int32)
                flat = made.reshape(len(made), -1)
                if shift:
                    mix = np.einsum("np,np->n", flat.astype(np.int64), weights[b.column(shift).to_numpy() % 97])
                else:
                    mix = (flat.astype(np.float64) @ weights[0].astype(np.float64)).astype(np.int64)  # exact: below 2**53
                sums = (np.full(len(flat), flat.shape[1]), flat.sum(1, dtype=np.int64), mix)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *[pa.array(x, pa.int64()) for x in sums]], names=schema.names)

    return frames.select(*keys, "luma").mapInArrow(run, schema)


def total(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of digested() rows by key."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "v_sum", "v_mix")])


def listed_pixels(rectangles: DataFrame, h: int, w: int) -> DataFrame:
    """rectangles (y0, x0, y1, x1; ends excluded) with a row for each of their pixels (y, x) within frames of h x w, and without their sides."""
    inside = rectangles.withColumns({"y0": F.expr("greatest(0, y0)"), "x0": F.expr("greatest(0, x0)"), "y1": F.expr(f"least({h}, y1)"), "x1": F.expr(f"least({w}, x1)")})
    kept = [c for c in rectangles.columns if c not in ("y0", "x0", "y1", "x1")]
    i = inside.where("y0 < y1 and x0 < x1").select("*", F.explode(F.expr("sequence(0, (y1 - y0) * (x1 - x0) - 1)")).alias("i"))
    return i.select(*kept, F.expr("cast(y0 + i div (x1 - x0) as int)").alias("y"), F.expr("cast(x0 + i % (x1 - x0) as int)").alias("x"))
