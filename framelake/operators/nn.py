"""Convolutions: relationally over feature maps (exact in integers), and whole networks over batches of tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .resample import axis_matrix, map_tiles


def conv2d(fmap: DataFrame, weights: DataFrame, k: int, size: int) -> DataFrame:
    """(patch_id, c, y, x, v): zero-padded convolution of (patch_id, c, y, x, v) of size x size maps.

    weights is a layer's small table (its size is set by the network); products are summed where
    they land, with partial sums before the shuffle.
    """
    joined = fmap.join(F.broadcast(weights), fmap["c"] == weights["in_ch"])
    pad = k // 2
    landed = joined.select("patch_id", F.col("out_ch").alias("c"), (F.col("y") - F.col("ky") + pad).cast("int").alias("y"), (F.col("x") - F.col("kx") + pad).cast("int").alias("x"), (F.col("v") * F.col("w")).alias("p"))
    return landed.where(f"y between 0 and {size - 1} and x between 0 and {size - 1}").groupBy("patch_id", "c", "y", "x").agg(F.sum("p").alias("v"))


def conv_transpose2d(fmap: DataFrame, weights: DataFrame, k: int, size: int, stride: int = 2) -> DataFrame:
    """Transposed convolution: each input pixel scatters the kernel, to maps of stride * size."""
    joined = fmap.join(F.broadcast(weights), fmap["c"] == weights["in_ch"])
    pad = k // 2
    landed = joined.select("patch_id", F.col("out_ch").alias("c"), (F.col("y") * stride + F.col("ky") - pad).cast("int").alias("y"), (F.col("x") * stride + F.col("kx") - pad).cast("int").alias("x"), (F.col("v") * F.col("w")).alias("p"))
    return landed.where(f"y between 0 and {size * stride - 1} and x between 0 and {size * stride - 1}").groupBy("patch_id", "c", "y", "x").agg(F.sum("p").alias("v"))


def zero_insert(fmap: DataFrame, stride: int, size: int) -> DataFrame:
    """Maps of stride * size with the inputs at multiples of stride and zero between."""
    spread = f"transform(sequence(0, {stride * stride - 1}), i -> struct(cast(y * {stride} + i div {stride} as int) as y, cast(x * {stride} + i % {stride} as int) as x, if(i = 0, v, 0) as v))"
    return fmap.select("patch_id", "c", F.inline(F.expr(spread)))


def pad(fmap: DataFrame, by: int, size: int) -> DataFrame:
    """Maps with a border of zeros; a border pixel is made by the corner or edge pixel next to it."""
    axis = lambda c: f"case when {c} = 0 then sequence(0, {by}) when {c} = {size - 1} then sequence({size - 1 + by}, {size - 1 + 2 * by}) else array({c} + {by}) end"
    spread = fmap.withColumn("ny", F.explode(F.expr(axis("y")))).withColumn("nx", F.explode(F.expr(axis("x"))))
    return spread.select("patch_id", "c", F.col("ny").cast("int").alias("y"), F.col("nx").cast("int").alias("x"), F.expr(f"if(ny = y + {by} and nx = x + {by}, v, 0)").alias("v"))


def convolve(df: DataFrame, pix: str, out: str, size: int, weights: np.ndarray, bias: np.ndarray | None = None, slopes: np.ndarray | None = None, up: bool = False) -> DataFrame:
    """df with out: one layer over the channel planes in pix, exact in integers; no pixel leaves its row.

    weights (out, in, k, k), bias and slopes are integers in units of 2**-12. With slopes the result is
    in units of 2**-24: what is below zero has its channel's slope. up is a transposed convolution
    that doubles the size. conv2d() and conv_transpose2d() do the same over rows of pixels.
    """
    return map_tiles(df, pix, out, convolve_kernel(size, weights, bias, slopes, up), "bigint")


def convolve_kernel(size: int, weights: np.ndarray, bias: np.ndarray | None = None, slopes: np.ndarray | None = None, up: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """The kernel of convolve()."""
    exact = (weights[:, :, ::-1, ::-1] if up else weights).astype(float)  # each pixel scatters the kernel; sums stay below 2**53

    def kernel(pixels: np.ndarray) -> np.ndarray:
        x = pixels.astype(float).reshape(len(pixels), -1, size, size)
        y = np.rint((_conv_up if up else _conv)(x, exact)).astype(np.int64)
        if bias is not None:
            y = y + bias[:, None, None]
        if slopes is not None:
            y = np.where(y >= 0, y * 4096, y * slopes[:, None, None])
        return y.reshape(len(x), -1)

    return kernel


def narrow_convolve(pixels: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """(tiles, values): as convolve(), but each product of a pixel and a weight loses its 12 last bits before it is added."""
    x, k = pixels.reshape(len(pixels), -1, size, size), weights.shape[2]
    p = np.pad(x.astype(np.int64), ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    parts = [(p[:, None, :, ky : ky + size, kx : kx + size] * weights[:, :, ky, kx, None, None] >> 12).sum(2) for ky in range(k) for kx in range(k)]
    return sum(parts).reshape(len(x), -1)


def collapse_weights(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each layer's weights for a k x k convolution followed by a 1 x 1 one."""
    two = second.select("layer", F.col("out_ch").alias("o"), F.col("in_ch").alias("out_ch"), F.col("w").alias("w2"))
    return first.join(two, ["layer", "out_ch"]).groupBy("layer", F.col("o").alias("out_ch"), "in_ch", "ky", "kx").agg(F.sum(F.col("w") * F.col("w2")).alias("w"))


def collapse_bias(second: DataFrame, bias1: DataFrame, bias2: DataFrame) -> DataFrame:
    """(layer, out_ch, b): each layer's bias for a convolution with bias1 followed by a 1 x 1 one (second) with bias2, both (layer, out_ch, b), in units of 2**-24.

    The first bias goes through the second layer's weights. A channel without bias has zero.
    """
    through = second.select("layer", "out_ch", F.col("in_ch").alias("mid"), "w").join(bias1.select("layer", F.col("out_ch").alias("mid"), F.col("b").alias("b1")), ["layer", "mid"])
    moved = through.groupBy("layer", "out_ch").agg(F.sum(F.col("w") * F.col("b1")).alias("moved"))
    return moved.join(bias2, ["layer", "out_ch"], "full_outer").select("layer", "out_ch", (F.coalesce("moved", F.lit(0)) + F.coalesce(F.col("b") * 4096, F.lit(0))).alias("b"))


#: Layers as (kind, in, out, kernel): 'conv', or 'up' for a transposed convolution that doubles the size; 'mark' keeps
#: what comes in, 'add' adds it again, 'shuffle' turns channels into pixels.
SMALL = [("conv", 3, 16, 5), ("conv", 16, 12, 1), ("conv", 12, 12, 3), ("conv", 12, 12, 3), ("conv", 12, 8, 3), ("conv", 8, 8, 1), ("up", 8, 3, 7)]
LUMA = [("conv", 1, 56, 5), ("conv", 56, 12, 1), *[("conv", 12, 12, 3)] * 4, ("conv", 12, 56, 1), ("up", 56, 1, 9)]
COLOUR = [("conv", 3, 56, 5), *LUMA[1:-1], ("up", 56, 3, 9)]
RESIDUAL = [("conv", 3, 64, 3), *[("conv", 64, 64, 3)] * 6, ("mark", 64, 64, 0), *[("conv", 64, 64, 3)] * 6, ("add", 64, 64, 0), ("conv", 64, 12, 3), ("shuffle", 12, 3, 2)]
SPECS = {"small": SMALL, "luma": LUMA, "colour": COLOUR, "residual": RESIDUAL}


def network_weights(spec: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """(weights, bias, slopes) of each layer by a formula of their place, of a size that keeps values from dying out over the layers.

    A layer whose inputs stand two apart ('up') gets more. The last 'up' layer lifts its output to
    mid-grey. A layer of the small network has a slope for each channel, the others one for all; the
    residual network cuts off below zero.
    """
    out: list[tuple | None] = []
    last = max(at for at, x in enumerate(spec) if x[0] in ("conv", "up"))
    for layer, (kind, i, o, k) in enumerate(spec):
        if kind not in ("conv", "up"):
            out.append(None)
            continue
        n = np.arange(o * i * k * k, dtype=np.int64)
        h = ((n % 1000003) * 48271 + (layer + 1) * 69621) % 2147483647
        w = ((h % 2049 - 1024) / 1024 * np.sqrt({"up": 24}.get(kind, 6) / (i * k * k))).astype(np.float32).reshape(o, i, k, k)
        slopes = 0.25 + np.arange(o) % 4 / 16 if spec is SMALL else np.full(o, 0.0 if spec is RESIDUAL else 0.25 + layer / 64)
        out.append((w, np.full(o, 0.4 if layer == last and kind == "up" else 0, np.float32), slopes.astype(np.float32)))
    return out


def _conv(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(n, in, h, w) with (out, in, k, k): zero-padded, one matrix product with the neighbourhoods side by side."""
    n, c, h, wd = x.shape
    k = w.shape[2]
    if k > 1:
        p = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
        x = np.lib.stride_tricks.sliding_window_view(p, (k, k), axis=(2, 3)).transpose(0, 1, 4, 5, 2, 3)
    return (w.reshape(len(w), -1) @ x.reshape(n, c * k * k, h * wd)).reshape(n, len(w), h, wd)


def _conv_up(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """As _conv() over x with a zero after each row and column, without working on the zeros.

    One matrix product gives what each pixel adds at each place of the kernel; these land two apart.
    """
    (n, c, h, wd), (o, _, k, _) = x.shape, w.shape
    parts = (w.transpose(2, 3, 0, 1).reshape(-1, c) @ x.reshape(n, c, h * wd)).reshape(n, k, k, o, h, wd)
    border = k // 2
    out = np.zeros((n, o, 2 * (h + border), 2 * (wd + border)), x.dtype)
    for ky in range(k):
        for kx in range(k):
            y0, x0 = 2 * border - ky, 2 * border - kx
            out[:, :, y0 : y0 + 2 * h : 2, x0 : x0 + 2 * wd : 2] += parts[:, ky, kx]
    return out[:, :, border : border + 2 * h, border : border + 2 * wd]


def _conv_phases(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Transposed convolution of stride 2 by its four phases: each is an ordinary convolution by every second row and column of the kernel.

    Output row 2m + p gets input rows m + (p + pad - ky) / 2 for kernel rows ky of the parity of p + pad.
    Phases are interleaved; no zero is inserted and nothing is scattered.
    """
    (n, c, h, wd), (o, _, k, _) = x.shape, w.shape
    border, reach = k // 2, k // 2 + 1
    p = np.pad(x, ((0, 0), (0, 0), (reach, reach), (reach, reach)))
    out = np.zeros((n, o, 2 * h, 2 * wd), x.dtype)
    for py in (0, 1):
        for px in (0, 1):
            ys, xs = ([ki for ki in range(k) if (s + border - ki) % 2 == 0] for s in (py, px))
            seen = [p[:, :, reach + dy : reach + dy + h, reach + dx : reach + dx + wd] for dy in ((py + border - ky) // 2 for ky in ys) for dx in ((px + border - kx) // 2 for kx in xs)]
            if not seen:  # a kernel of one value has a single phase
                continue
            part = w[:, :, ys][:, :, :, xs].transpose(0, 2, 3, 1).reshape(o, -1)
            out[:, :, py::2, px::2] = (part @ np.stack(seen, 1).reshape(n, -1, h * wd)).reshape(n, o, h, wd)
    return out


def transpose_convolve(df: DataFrame, pix: str, out: str, size: int, weights: np.ndarray) -> DataFrame:
    """df with out: as convolve() with up, by polyphase kernels; weights scatter, as they stand."""

    def kernel(pixels: np.ndarray) -> np.ndarray:
        x = pixels.astype(float).reshape(len(pixels), -1, size, size)
        return np.rint(_conv_phases(x, weights.astype(float))).astype(np.int64).reshape(len(x), -1)

    return map_tiles(df, pix, out, kernel, "bigint")


def run_network(x: np.ndarray, spec: list[tuple], weights: list[tuple | None], fraction: int = 0) -> np.ndarray:
    """Network over a batch (n, channels, h, w) of floats; the last layer has no activation.

    With fraction, weights and each layer's sums and activations are cut to so many binary places,
    as fixed-point numbers of a wide accumulator are.
    """
    cut = (lambda v: np.floor(v * (1 << fraction)) / (1 << fraction)) if fraction else (lambda v: v)
    last = max(at for at, layer in enumerate(spec) if layer[0] in ("conv", "up"))
    kept = x
    for at, ((kind, _, _, k), layer) in enumerate(zip(spec, weights, strict=True)):
        if kind == "shuffle":
            n, c, h, wd = x.shape
            x = x.reshape(n, c // (k * k), k, k, h, wd).transpose(0, 1, 4, 2, 5, 3).reshape(n, c // (k * k), h * k, wd * k)
        elif kind == "mark":
            kept = x
        elif kind == "add":
            x = x + kept
        else:
            w, b, a = layer
            y = cut((_conv_up if kind == "up" else _conv)(x, cut(w)) + cut(b)[:, None, None])
            x = cut(np.where(y >= 0, y, y * cut(a)[:, None, None])) if at < last else y
    return x


def network_kernel(weights: Broadcast, size: int, spec: str = "small", scale: int = 256, fraction: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """The kernel of score_tiles(): (tiles, channel planes) to (tiles, planes of twice the size), with network_weights() of the spec broadcast."""
    layers = SPECS[spec]
    channels, wide = layers[0][1], axis_matrix(size, 2 * size, "cubic").astype(np.float32)

    def kernel(pixels: np.ndarray) -> np.ndarray:
        x = pixels.astype(np.float64 if fraction else np.float32).reshape(-1, channels, size, size) / scale
        y = run_network(x, layers, weights.value, fraction)
        if spec == "residual":
            y = y + wide @ x @ wide.T
        return np.clip(np.floor(y * scale), 0, 255).reshape(len(x), -1)

    return kernel


def broadcast_weights(spark: SparkSession, spec: str) -> Broadcast:
    """Weights of a network, of a size that its layers set."""
    return spark.sparkContext.broadcast(network_weights(SPECS[spec]))


def score_tiles(tiles: DataFrame, pix: str, size: int, spec: str = "small", scale: int = 256, batch: int = 16, fraction: int = 0) -> DataFrame:
    """tiles with out: the network over column pix (channel planes in one array), twice as wide and high, 0..255, saturated.

    The residual network's output is added to its input upscaled by cubic convolution. Only tiles
    that need the network should come here: batches go to Python by Arrow.
    """
    return map_tiles(tiles, pix, "out", network_kernel(broadcast_weights(tiles.sparkSession, spec), size, spec, scale, fraction), "int", batch)


def integer_kernel(size: int, first: tuple[np.ndarray, np.ndarray, np.ndarray], up: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A network of two layers in integers: a convolution (weights, bias, slopes) cut to whole numbers, and a transposed one (weights) that doubles the size, cut and saturated.

    Weights, bias and slopes are in units of 2**-12. Sums stay below 2**53, so matrix products are exact.
    """
    weights, bias, slopes = first
    turned = up[:, :, ::-1, ::-1].astype(float)

    def kernel(pixels: np.ndarray) -> np.ndarray:
        x = pixels.astype(float).reshape(len(pixels), -1, size, size)
        y = np.rint(_conv(x, weights.astype(float))).astype(np.int64) + bias[:, None, None]
        y = np.where(y >= 0, y * 4096, y * slopes[:, None, None]) >> 24
        z = np.rint(_conv_up(y.astype(float), turned)).astype(np.int64) >> 12
        return np.clip(z, 0, 255).reshape(len(x), -1)

    return kernel
