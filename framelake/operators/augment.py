"""Degradation and augmentation of tiles (arrays in raster order), for training pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from .resample import downscale, map_tiles


#: Luma and colour differences of red, green and blue, and the way back.
RGB_TO_YUV = ((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100))
YUV_TO_RGB = ((1.0, 0.0, 1.140), (1.0, -0.395, -0.581), (1.0, 2.032, 0.0))


def gaussian_taps(sigma: float, reach: int | None = None) -> list[float]:
    reach = reach or max(1, math.ceil(3 * sigma))
    w = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [x / sum(w) for x in w]


def blur_matrix(n: int, taps: list[float]) -> np.ndarray:
    """Weighted sums along an axis of n places, edges reflected."""
    out = np.zeros((n, n))
    for o in range(n):
        for k, t in enumerate(taps):
            i = (o + k - len(taps) // 2) % (2 * n)
            out[o, i if i < n else 2 * n - 1 - i] += t
    return out


def gaussian_blur(df: DataFrame, pix: str, out: str, w: int, h: int, sigma: float, down: bool = True) -> DataFrame:
    """df with out: the tile in pix blurred along rows, and along columns too if down."""
    taps = gaussian_taps(sigma)
    x, y = blur_matrix(w, taps).T, blur_matrix(h, taps) if down else np.eye(h)
    return map_tiles(df, pix, out, lambda tiles: (y @ (tiles.reshape(-1, h, w).astype(float) @ x)).reshape(len(tiles), -1), "double")


def chroma_bleed(df: DataFrame, u: str, v: str, w: int, h: int, sigma: float = 2) -> DataFrame:
    """df with u and v blurred along rows only."""
    once = gaussian_blur(df.withColumnRenamed(u, "_u"), "_u", u, w, h, sigma, False).drop("_u")
    return gaussian_blur(once.withColumnRenamed(v, "_v"), "_v", v, w, h, sigma, False).drop("_v")


def bleed_rgb(df: DataFrame, planes: str, out: str, w: int, h: int, sigma: float = 2) -> DataFrame:
    """df with out: red, green and blue planes, one after another in one array, whose colour differences are blurred along rows up to four sigmas.

    Luma stays; the planes are doubles, not clipped, and come back as they went where a row has one colour.
    """
    x = blur_matrix(w, gaussian_taps(sigma, int(4 * sigma + 0.5))).T

    def kernel(tiles: np.ndarray) -> np.ndarray:
        rgb = tiles.reshape(len(tiles), 3, h, w).astype(float)
        yuv = np.einsum("ij,njyx->niyx", np.array(RGB_TO_YUV), rgb)
        yuv[:, 1:] = yuv[:, 1:] @ x
        return np.einsum("ij,njyx->niyx", np.array(YUV_TO_RGB), yuv).reshape(len(tiles), -1)

    return map_tiles(df, planes, out, kernel, "double")


def jitter_rgb(df: DataFrame, key: str, planes: str, out: str, w: int, h: int, copies: int = 3, seed: int = 40) -> DataFrame:
    """`copies` rows of each tile, each with another saturation, hue and blur, or not, by a hash of key and copy; out has the planes of bytes.

    Saturation mixes a pixel with its grey, 0.8 to 1.2 times as far from it; hue is turned by up to
    a tenth of the circle; both or none happen. The blur is of three by three pixels with a sigma
    of 0.1 to 0.3, reflected without the edge itself.
    """
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = lambda s, n: numbers.below(F.col(key) * copies + F.col("copy"), n, seed + s).cast("int")
    half = lambda s, x, default: F.when(draw(s, 2) == 1, x).otherwise(default)
    sigma = (draw(4, 21) + 10) / 100.0
    rows = rows.withColumns({"saturation": half(1, (draw(2, 41) + 80) / 100.0, 1.0), "hue": half(1, (draw(3, 41) - 20) / 200.0, 0.0), "side": half(5, F.exp(-1.0 / (F.lit(2.0) * sigma * sigma)), 0.0)})
    n = w * h
    byte = lambda a: np.floor(np.clip(a, 0, 255) + 0.5)

    def blur(planes: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Planes (tiles, 3, rows, places) blurred along the last axis."""
        more = np.pad(planes, ((0, 0), (0, 0), (0, 0), (1, 1)), "reflect")
        return (side * more[..., :-2] + more[..., 1:-1] + side * more[..., 2:]) / (1 + 2 * side)

    def kernel(tiles: np.ndarray) -> np.ndarray:
        saturation, hue, side = (tiles[:, 3 * n + i].reshape(-1, 1) for i in range(3))
        r, g, b = (tiles[:, i * n : (i + 1) * n] for i in range(3))
        grey = 0.299 * r + 0.587 * g + 0.114 * b
        r, g, b = (byte(saturation * c + (1 - saturation) * grey) for c in (r, g, b))
        top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        span = top - low
        safe = np.maximum(span, 1)
        turn = np.where(top == r, (g - b) / safe, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) + 6 * hue
        rgb = []
        for k in (5, 3, 1):
            k = turn + k
            k = k - 6 * np.floor(k / 6)
            rgb.append(byte(top - span * np.maximum(0, np.minimum(np.minimum(k, 4 - k), 1))))
        side, image = side.reshape(-1, 1, 1, 1), np.stack(rgb, 1).reshape(len(tiles), 3, h, w)
        return byte(blur(blur(image, side).swapaxes(2, 3), side).swapaxes(2, 3)).reshape(len(tiles), -1)

    packed = rows.withColumn("_in", F.concat(F.transform(planes, lambda v: v.cast("double")), F.array("saturation", "hue", "side")))
    return map_tiles(packed, "_in", out, kernel).drop("_in")


def scanlines(pix: str, w: int, k: float = 0.003) -> Column:
    """Even rows darkened by k."""
    return F.expr(f"transform({pix}, (p, i) -> if((i div {w}) % 2 = 0, p * (1D - {k}D), cast(p as double)))")


def add_noise(df: DataFrame, pix: str, key: str, sigma: float, out: str | None = None, seed: int = 9) -> DataFrame:
    """df with Gaussian noise on pix (in out, if it has another name), from two numbers of the key that are carried on by place, clipped to 0..255."""
    t = lambda m: f"(({m} + i * 630360016L) % 2147483647)"
    u = lambda m: f"(({t(m)} * ({t(m)} % 65521 + 1)) % 2147483647 + 1) / 2147483648D"  # noqa: E731  # squared, so that neighbours have nothing in common
    drawn = df.withColumns({f"_m{i}": numbers.mixed(F.col(key), seed + i)[0] for i in (0, 1)})
    noisy = f"transform({pix}, (p, i) -> cast(greatest(0D, least(255D, floor(p + {sigma}D * sqrt(-2 * ln({u('_m0')})) * cos(6.283185307179586D * {u('_m1')}) + 0.5D))) as int))"
    return drawn.withColumn(out or pix, F.expr(noisy)).drop("_m0", "_m1")


def augment(df: DataFrame, key: str, pix: str, w: int, h: int, copies: int = 3, seed: int = 4) -> DataFrame:
    """`copies` rows of each tile, each with brightness, contrast, sharpness and a small affine map, or not, by a hash of key and copy.

    Sharpness goes between the tile smoothed by nine neighbours (the middle one five times; edges
    stay) and twice as far from it. The affine map takes a pixel from x + ax * x / 64 + ay * y / 64 +
    dx / 8, and likewise from y, held inside, mixed from the four pixels around.
    """
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    draw = lambda s, n: numbers.below(F.col(key) * copies + F.col("copy"), n, seed + s).cast("int")
    half = lambda s, x, default: F.when(draw(s, 2) == 1, x).otherwise(default)
    jitter = {"bright": half(1, draw(2, 41) - 20, 0), "contrast": half(3, (draw(4, 41) + 80) / 100.0, 1.0), "sharp": half(5, draw(6, 41) / 20.0, 1.0)}
    affine = {c: half(7, draw(8 + i, n) - n // 2, 0) for i, (c, n) in enumerate({"ax": 5, "ay": 9, "bx": 9, "by": 5, "dx": 17, "dy": 17}.items())}
    rows = rows.withColumns(jitter | affine)
    byte = lambda e: f"cast(greatest(0D, least(255D, floor({e} + 0.5D))) as int)"
    once = lambda e: F.explode(F.array(F.expr(e)))  # noqa: E731  # a generator's output is computed once however often later steps use it
    coloured = rows.withColumn("_c", once(f"transform({pix}, p -> {byte('(p - 128) * contrast + 128 + bright')})"))
    near = " + ".join(f"_c[i + {dy * w + dx}]" for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + " + 4 * _c[i]"
    inner = f"i div {w} between 1 and {h - 2} and i % {w} between 1 and {w - 2}"
    sharp = coloured.withColumn("_s", once(f"transform(_c, (p, i) -> if({inner}, {byte(f'({near}) / 13D + sharp * (p - ({near}) / 13D)')}, p))"))
    x = f"greatest(0D, least({w - 1}D, i % {w} + ax * (i % {w}) / 64D + ay * (i div {w}) / 64D + dx / 8D))"
    y = f"greatest(0D, least({h - 1}D, i div {w} + bx * (i % {w}) / 64D + by * (i div {w}) / 64D + dy / 8D))"
    at = sharp.withColumn("_at", once(f"transform(sequence(0, {w * h - 1}), i -> struct({x} as x, {y} as y))"))
    corner = lambda j, k: f"_s[cast(least({h - 1}, floor(a.y) + {j}) as int) * {w} + cast(least({w - 1}, floor(a.x) + {k}) as int)]"
    fx, fy = "(a.x - floor(a.x))", "(a.y - floor(a.y))"
    mixed = f"(1 - {fx}) * (1 - {fy}) * {corner(0, 0)} + {fx} * (1 - {fy}) * {corner(0, 1)} + (1 - {fx}) * {fy} * {corner(1, 0)} + {fx} * {fy} * {corner(1, 1)}"
    return at.withColumn("augmented", F.expr(f"transform(_at, a -> {byte(mixed)})")).drop("_c", "_s", "_at")


def make_training_pairs(tiles: DataFrame, key: str, pix: str, size: int, factor: int = 2, copies: int = 3) -> DataFrame:
    """(key, copy, hi, lo): each tile with copies of its shrunk, scanlined, noisy and augmented version."""
    small = size // factor
    low = downscale(tiles, pix, "_low", size, size, factor)
    low = add_noise(low.withColumn("_low", scanlines("_low", small)), "_low", key, 1.5)
    made = augment(low, key, "_low", small, small, copies)
    return made.select(key, "copy", F.col(pix).alias("hi"), F.col("augmented").alias("lo"))
