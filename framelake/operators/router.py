"""Adaptive upscaling in one pass: each tile is scored, routed and upscaled where it is, and frames come with their tiles' report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql import types as T

from ..sources.frames import byte_matrix, list_column
from .resample import matrix, pack_planes

Kernel = Callable[[np.ndarray], np.ndarray]


def luma_scores(data: np.ndarray) -> np.ndarray:
    """Sum of squares about the integer mean of each YUYV tile's luma."""
    luma = data[:, ::2].astype(np.int64)
    n, total = luma.shape[1], luma.sum(1)
    mean = total // n
    return (luma * luma).sum(1) - 2 * mean * total + n * mean * mean


def route_sums(frames: DataFrame, threshold: float = 1000, at_once: int = 1024) -> DataFrame:
    """(stream, n_tiles, n_cnn, n_interp) of frames (stream, data: YUYV bytes, each one tile): a row for each stream of so many frames, to be summed up."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                data = byte_matrix(b.column("data"))
                cnn = luma_scores(data) / (data.shape[1] // 2) > threshold
                by = pa.table({"stream": b.column("stream"), "cnn": cnn.astype(np.int64)}).group_by("stream").aggregate([("cnn", "count"), ("cnn", "sum")])
                stream, n, n_cnn = (by.column(c).combine_chunks() for c in ("stream", "cnn_count", "cnn_sum"))
                yield pa.RecordBatch.from_arrays([stream, n, n_cnn, pc.subtract(n, n_cnn)], names=["stream", "n_tiles", "n_cnn", "n_interp"])

    return frames.select("stream", "data").mapInArrow(step, "stream string, n_tiles long, n_cnn long, n_interp long")


def upscale_routed(tiles: DataFrame, planes: Kernel, flat: Kernel, detailed: Kernel, threshold: float = 1000, override: int = 0, op: str = ">", batch: int = 16) -> DataFrame:
    """tiles (data: YUYV bytes) with route, variance and out instead of data.

    A tile is 'cnn' above the threshold ('>=': at it, too) and goes through detailed, else 'interp' and
    goes through flat; both take what planes makes of its bytes. Override 1 and 2 send all one way,
    and their variance, which nothing asks for, is null. Tiles go to Python once; of a batch each
    kernel sees only its own tiles.
    """
    kept = [c for c in tiles.columns if c not in ("data", "route", "variance", "out")]
    schema = StructType([tiles.schema[c] for c in kept]).add("route", T.StringType()).add("variance", T.DoubleType()).add("out", T.ArrayType(T.IntegerType()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                b = whole.slice(i, batch)
                data = matrix(b.column("data"))
                variance = None if override else luma_scores(data) / (data.shape[1] // 2)
                if override:
                    cnn = np.full(len(data), override == 1)
                else:
                    cnn = variance > threshold if op == ">" else variance >= threshold
                pixels, made = planes(data), [None, None]
                for k, kernel in enumerate((flat, detailed)):
                    if (cnn == k).any():
                        made[k] = kernel(pixels[cnn == k]).astype(np.int32)
                out = np.empty((len(data), next(m.shape[1] for m in made if m is not None)), np.int32)
                for k in (0, 1):
                    if made[k] is not None:
                        out[cnn == k] = made[k]
                route = pa.array(np.where(cnn, "cnn", "interp").tolist(), pa.string())
                scores = pa.nulls(len(data), pa.float64()) if variance is None else pa.array(variance)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], route, scores, list_column(out)], names=[*kept, "route", "variance", "out"])

    return tiles.mapInArrow(step, schema)


def observed(routed: DataFrame) -> tuple[DataFrame, Observation]:
    """routed, and what an action on it counts on its way: tiles, cnn, interp."""
    seen = Observation()
    cnn = F.count_if(F.col("route") == "cnn")
    return routed.observe(seen, F.count(F.lit(1)).alias("tiles"), cnn.alias("cnn"), (F.count(F.lit(1)) - cnn).alias("interp")), seen


def whole_frames(routed: DataFrame, w: int, h: int, packed: bool = False) -> DataFrame:
    """(frame_id, width, height, data, n_tiles, n_cnn, n_interp, tiles) of frames one tile wide, from tiles (frame_id, tile_y, route, variance, out) of three planes of w x h.

    data are rgb565 words; with packed, out holds them already. tiles is the report of (tile_y, route, variance). One grouping by frame gives it all.
    """
    routed = routed.select("frame_id", "tile_y", "route", "variance", "out")
    words = routed.withColumnRenamed("out", "word") if packed else pack_planes(routed, "out", "word")
    tiles = F.array_sort(F.collect_list(F.struct("tile_y", "route", "variance", "word")))
    by = words.groupBy("frame_id").agg(tiles.alias("t"))
    report = F.transform("t", lambda t: F.struct(t["tile_y"].alias("tile_y"), t["route"].alias("route"), t["variance"].alias("variance")))
    n, cnn = F.size("t"), F.size(F.filter("t", lambda t: t["route"] == "cnn"))
    counts = [x.cast("long").alias(c) for c, x in (("n_tiles", n), ("n_cnn", cnn), ("n_interp", n - cnn))]
    return by.select("frame_id", F.lit(w).alias("width"), (n * h).cast("int").alias("height"), F.flatten(F.transform("t", lambda t: t["word"])).alias("data"), *counts, report.alias("tiles"))
