"""Colour and value transforms as expressions over pixel tables (frame_id, y, x, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _byte(expr: str) -> Column:
    return F.expr(f"cast(greatest(0, least(255, {expr})) as int)")


def rgb_of(method: str = "fixed") -> dict[str, Column]:
    """r, g and b of luma, u and v: 'fixed' by shifted integers with rounding, 'float' truncated after clamping."""
    if method == "fixed":
        rgb = {
            "r": "luma + shiftright(1436 * (v - 128) + 512, 10)",
            "g": "luma - shiftright(352 * (u - 128) + 512, 10) - shiftright(732 * (v - 128) + 512, 10)",
            "b": "luma + shiftright(1811 * (u - 128) + 512, 10)",
        }
    else:
        rgb = {
            "r": "cast(luma + 1.403D * (v - 128) as int)",
            "g": "cast(luma - 0.344D * (u - 128) - 0.714D * (v - 128) as int)",
            "b": "cast(luma + 1.770D * (u - 128) as int)",
        }
    return {c: _byte(e) for c, e in rgb.items()}


def yuv_to_rgb(df: DataFrame, method: str = "fixed") -> DataFrame:
    """(frame_id, y, x, r, g, b)."""
    return df.select("frame_id", "y", "x", *[e.alias(c) for c, e in rgb_of(method).items()])


def pack_rgb565(df: DataFrame) -> DataFrame:
    return df.withColumn("rgb565", F.expr("shiftleft(r & 248, 8) | shiftleft(g & 252, 3) | shiftright(b, 3)"))


def unpack_rgb565(df: DataFrame, method: str = "scaled") -> DataFrame:
    """r, g, b of rgb565, scaled to 0..255 or shifted."""
    five, six = (("* 255 div 31", "* 255 div 63") if method == "scaled" else ("* 8", "* 4"))
    parts = {"r": f"(shiftright(rgb565, 11) & 31) {five}", "g": f"(shiftright(rgb565, 5) & 63) {six}", "b": f"(rgb565 & 31) {five}"}
    return df.withColumns({c: F.expr(f"cast({e} as int)") for c, e in parts.items()})


def yuv_to_rgb565(df: DataFrame) -> DataFrame:
    return pack_rgb565(yuv_to_rgb(df, "float")).drop("r", "g", "b")


def quantisation_loss(df: DataFrame) -> DataFrame:
    """(frame_id, mse) of masking to 565."""
    return df.groupBy("frame_id").agg(F.round(F.sum(F.expr("(r & 7) * (r & 7) + (g & 3) * (g & 3) + (b & 7) * (b & 7)")) / (F.count("*") * 3), 6).alias("mse"))


#: Rows of y, u and v over r, g and b.
MATRICES = {
    "bt601": ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001)),
    "rounded": ((0.299, 0.587, 0.114), (-0.147, -0.289, 0.436), (0.615, -0.515, -0.100)),
    "offset": ((0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081)),
}


def rgb_to_yuv(df: DataFrame, matrix: str = "bt601") -> DataFrame:
    """(frame_id, y, x, luma, u, v); 'offset' gives integers with u and v around 128, the others doubles."""
    rows = [" + ".join(f"{w}D * {c}" for w, c in zip(row, "rgb", strict=True)) for row in MATRICES[matrix]]
    if matrix == "offset":
        cols = [_byte(f"cast(floor({e}) as int)" if i == 0 else f"cast(floor({e} + 128D) as int)") for i, e in enumerate(rows)]
    else:
        cols = [F.expr(e) for e in rows]
    return df.select("frame_id", "y", "x", *[c.alias(n) for c, n in zip(cols, ("luma", "u", "v"), strict=True)])


def inverse(matrix: tuple) -> list[list[float]]:
    """Inverse of a 3 x 3 matrix by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = matrix
    co = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    det = a * co[0][0] + b * co[1][0] + c * co[2][0]
    return [[x / det for x in row] for row in co]


def roundtrip_error(df: DataFrame, matrix: str = "bt601", inverse_of: str | None = None) -> DataFrame:
    """(frame_id, worst): largest error of a channel after RGB to YUV and back, by the inverse of the same matrix or of another."""
    back = [F.expr(" + ".join(f"{w!r}D * {c}" for w, c in zip(row, ("luma", "u", "v"), strict=True))) for row in inverse(MATRICES[inverse_of or matrix])]
    forward = [" + ".join(f"{w}D * {c}" for w, c in zip(row, "rgb", strict=True)) for row in MATRICES[matrix]]
    made = df.withColumns({n: F.expr(e) for n, e in zip(("luma", "u", "v"), forward, strict=True)})
    return made.groupBy("frame_id").agg(F.max(F.greatest(*[F.abs(e - F.col(c)) for e, c in zip(back, "rgb", strict=True)])).alias("worst"))


def subsample_422(df: DataFrame) -> DataFrame:
    """(frame_id, y, pair, y0, u, y1, v): chroma averaged over pixel pairs, of integer luma, u, v."""
    grouped = df.groupBy("frame_id", "y", F.expr("x div 2").cast("int").alias("pair"))
    even = F.col("x") % 2 == 0
    return grouped.agg(F.max(F.when(even, F.col("luma"))).alias("y0"), F.expr("sum(u) div 2").cast("int").alias("u"), F.max(F.when(~even, F.col("luma"))).alias("y1"), F.expr("sum(v) div 2").cast("int").alias("v"))


def invert(df: DataFrame) -> DataFrame:
    return df.withColumns({c: 255 - F.col(c) for c in "rgb"})


def to_gray(df: DataFrame) -> DataFrame:
    """gray of r, g, b in 14-bit weights, rounded."""
    return df.withColumn("gray", F.expr("cast(shiftright(4899 * r + 9617 * g + 1868 * b + 8192, 14) as int)"))


def pack_beats(tiles: DataFrame) -> DataFrame:
    """(stream, frame_id, seq, data, last): 16-byte beats of a tile's bytes in hexadecimal, the last one marked."""
    digits = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)
    names = ["stream", "frame_id", "seq", "data_hex", "last"]

    def beats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            n = 128 * b.num_rows
            data = digits[b.column("data").flatten().to_numpy()]
            ends = np.arange(n + 1, dtype=np.int32) * 32
            seq = np.repeat(b.column("tile_y").to_numpy() * 128, 128) + np.tile(np.arange(128), b.num_rows)
            of = pa.array(np.repeat(np.arange(b.num_rows), 128))
            columns = [b.column("stream").take(of), b.column("frame_id").take(of), pa.array(seq, pa.int32()), pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]), pa.array(seq % 128 == 127)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return tiles.select("stream", "frame_id", "tile_y", "data").mapInArrow(beats, "stream string, frame_id long, seq int, data_hex string, last boolean")


def unpack_beats(beats: DataFrame) -> DataFrame:
    """(frame_id, seq, bytes) of beats."""
    digit = lambda at: f"(locate(substr(h, {at}, 1), '123456789abcdef'))"  # noqa: E731  0: not found
    byte = f"{digit('2 * i + 1')} * 16 + {digit('2 * i + 2')}"
    return beats.select("frame_id", "seq", F.lower("data_hex").alias("h")).select("frame_id", "seq", F.expr(f"transform(sequence(0, 15), i -> {byte})").alias("bytes"))


def pack_words(df: DataFrame) -> DataFrame:
    """word: r, g, b from the low byte up, with a pad byte of zero."""
    return df.withColumn("word", F.expr("cast(r as bigint) | shiftleft(cast(g as bigint), 8) | shiftleft(cast(b as bigint), 16)"))


def unpack_words(df: DataFrame) -> DataFrame:
    return df.withColumns({"r": F.expr("cast(word & 255 as int)"), "g": F.expr("cast(shiftright(word, 8) & 255 as int)"), "b": F.expr("cast(shiftright(word, 16) & 255 as int)")})


def to_planar(df: DataFrame) -> DataFrame:
    """(frame_id, c, y, x, value): a row for each channel."""
    return df.select("frame_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("c", "value"))


def to_interleaved(planes: DataFrame) -> DataFrame:
    """r, g, b from a row for each channel."""
    return planes.groupBy("frame_id", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(c) for i, c in enumerate("rgb")])


def normalise(col: Column, scale: int = 256) -> Column:
    return col / F.lit(float(scale))


def denormalise(col: Column, scale: int = 256) -> Column:
    """Back to 0..255, truncated; what is above saturates."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(col * float(scale)))).cast("int")


def minmax_normalise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with stretched: value over its group's range, 0 to 1; null where the group is constant."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("stretched", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)))


def quantise_fixed(col: Column, bits: int, integer: int, rounding: str = "trunc", overflow: str = "wrap") -> Column:
    """col as a signed fixed-point number of so many bits, as the scaled integer."""
    scaled = col * float(1 << (bits - integer))
    whole = F.floor(scaled + 0.5) if rounding == "round" else F.floor(scaled)
    half = 1 << (bits - 1)
    if overflow == "saturate":
        return F.greatest(F.lit(-half), F.least(F.lit(half - 1), whole)).cast("long")
    return (F.pmod(whole + half, F.lit(1 << bits)) - half).cast("long")


def prelu(df: DataFrame, slopes: DataFrame, value: str = "v") -> DataFrame:
    """value less steep below zero, by a channel's slope in units of 2**-12; slopes has a row for each channel of a layer."""
    return df.join(F.broadcast(slopes), "c").withColumn(value, F.when(F.col(value) >= 0, F.col(value) * 4096).otherwise(F.col(value) * F.col("a"))).drop("a")


def relu(df: DataFrame, value: str = "v") -> DataFrame:
    return df.withColumn(value, F.greatest(F.lit(0), F.col(value)))


def format_duration(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def format_duration_units(seconds: Column) -> Column:
    """Hours and minutes where there are any, then seconds with milliseconds, as in '1h 2m 3.004s'."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    h, m = F.floor(ms / 3600000).cast("long"), (F.floor(ms / 60000) % 60).cast("long")
    rest = F.concat((F.floor(ms / 1000) % 60).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("s"))
    return F.concat_ws(" ", F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))), F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("m"))), rest)
