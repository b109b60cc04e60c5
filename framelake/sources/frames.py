"""Frame sources: raw buffers, listings, pairs, dumps, weights; and frames derived from ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

IMAGE_NAMES = r"\.(png|jpg|jpeg|bmp|webp)$"
TILE, TILE_BYTES = 32, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(key: Column, seed: int = 0) -> Column:
    """A number below 2**31 - 1 for an integer key, alike in any SQL engine."""
    return ((key.cast("long") % 1000003) * 48271 + seed * 69621) % 2147483647


# --- files -------------------------------------------------------------------------------------


def scan_images(names: DataFrame, column: str = "name") -> DataFrame:
    """Names of images, without hidden files."""
    return names.where(F.lower(column).rlike(IMAGE_NAMES) & ~F.col(column).startswith("."))


def pair_manifest(high: DataFrame, low: DataFrame, suffix: str = "_downscaled") -> DataFrame:
    """(hi, lo) of names where lo is hi with the suffix before its extension."""
    derived = F.regexp_replace("name", r"(\.[^.]+)$", suffix + "$1")
    return high.select(F.col("name").alias("hi"), derived.alias("lo")).join(low.select(F.col("name").alias("lo")), "lo").select("hi", "lo")


def missing_pairs(high: DataFrame, low: DataFrame, suffix: str = "_downscaled") -> DataFrame:
    """Names of high that have no partner in low."""
    derived = F.regexp_replace("name", r"(\.[^.]+)$", suffix + "$1")
    return high.select(F.col("name").alias("hi"), derived.alias("lo")).join(low.select(F.col("name").alias("lo")), "lo", "left_anti").select("hi")


def numbered(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in a total order, without one task that sorts all.

    Range partitions are sorted side by side and written once, each row with its place in its
    partition; they are then shifted by the sizes of the partitions before them, of which there are
    as many as partitions. Read twice, the written rows are the same; computed twice, they need not be.
    """
    keys = [f"k{i}" for i in range(len(order))]
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys, strict=True)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("at")), "ranged")
    placed = ranged.withColumns({"part": F.shiftright("at", 33), "local": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), "part").select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], (F.col("before") + F.col("local")).alias(name))


def zip_by_position(a: DataFrame, b: DataFrame, a_order: list[str], b_order: list[str]) -> DataFrame:
    """Rows of a and b side by side by their places; a row without partner stands alone."""
    left, right = numbered(a, a_order), numbered(b, b_order)
    return left.join(right, "pos", "full_outer")


def write_training_set(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").partitionBy("split").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Appends (run, tag, step, value), in a folder for each run."""
    metrics.write.mode("append").partitionBy("run").parquet(path)


# --- weights -----------------------------------------------------------------------------------


def weights_table(spark: SparkSession, layer: int, out_ch: int, in_ch: int, k: int) -> DataFrame:
    """(layer, out_ch, in_ch, ky, kx, w): integers in units of 2**-12 by a formula of their place."""
    grid = spark.range(out_ch * in_ch * k * k)
    i = F.col("id")
    place = [F.lit(layer).alias("layer"), F.floor(i / (in_ch * k * k)).cast("int").alias("out_ch"), (F.floor(i / (k * k)) % in_ch).cast("int").alias("in_ch"), (F.floor(i / k) % k).cast("int").alias("ky"), (i % k).cast("int").alias("kx")]
    w = hashed(((F.col("layer") * 64 + F.col("out_ch")) * 64 + F.col("in_ch")) * 81 + F.col("ky") * 9 + F.col("kx"), 5) % 2049 - 1024
    return grid.select(*place).withColumn("w", w.cast("long"))


def weights_array(layer: int, out_ch: int, in_ch: int, k: int) -> np.ndarray:
    """As weights_table(), as an (out_ch, in_ch, k, k) array."""
    o, i, y, x = np.indices((out_ch, in_ch, k, k), np.int64)
    place = ((layer * 64 + o) * 64 + i) * 81 + y * 9 + x
    return (place % 1000003 * 48271 + 5 * 69621) % 2147483647 % 2049 - 1024


def layer_values(layer: int, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(bias, slopes) of a layer by a formula, in units of 2**-12."""
    key = layer * 64 + np.arange(channels, dtype=np.int64)
    return tuple((key % 1000003 * 48271 + seed * 69621) % 2147483647 % n - low for seed, n, low in ((6, 40001, 20000), (7, 2048, 0)))


def flip_transposed(weights: DataFrame, k: int) -> DataFrame:
    """Weights of the convolution that a transposed one equals over a zero-inserted input: turned by 180 degrees, channels swapped."""
    return weights.select("layer", F.col("in_ch").alias("out_ch"), F.col("out_ch").alias("in_ch"), (k - 1 - F.col("ky")).alias("ky"), (k - 1 - F.col("kx")).alias("kx"), "w")


# --- frames from tables ------------------------------------------------------------------------


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, stream, k, data): documents as YUYV buffers of k tiles of 32 x 32, one byte a character; k = 0 is too short."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("frame_id"), F.col("lang").alias("stream"), F.expr("cast(n_chars div 2048 as int)").alias("k"), F.col("n_chars").alias("n_bytes"),
        F.expr("transform(split(text, ''), c -> ascii(c) % 256)").alias("data"),
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all cores where its scan has fewer partitions than these; a large scan isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores, *keys)


def _tile_bytes(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """Frame ids, streams, tile numbers and bytes (tiles, 2048) of the whole tiles of texts (frame_id, stream, text), so many at a time."""
    held: list[tuple] = []
    for batch in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):  # so few texts at a time as objects of Python
        for frame, stream, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = np.frombuffer((text or "").encode("utf-32-le"), np.uint8)[::4].copy()  # low byte of each code point
            tiles = data[: len(data) // TILE_BYTES * TILE_BYTES].reshape(-1, TILE_BYTES)
            for a in range(0, len(tiles), at_once):
                held.append((frame, stream, np.arange(a, min(a + at_once, len(tiles))), tiles[a : a + at_once]))
                if sum(len(x[2]) for x in held) >= at_once:
                    yield _joined(held)
                    held = []
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    n = [len(x[2]) for x in held]
    return np.repeat([x[0] for x in held], n), [s for (_, s, _, _), k in zip(held, n, strict=True) for _ in range(k)], np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])


def list_column(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel()))


def tiled_texts(docs: DataFrame) -> DataFrame:
    """(frame_id, stream, tile_y, data) of texts (frame_id, stream, text): a byte a character, 2048 bytes a tile; what doesn't fill a tile is left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, stream, tile, data in _tile_bytes(batches):
            yield pa.RecordBatch.from_arrays([pa.array(frame, pa.int64()), pa.array(stream, pa.string()), pa.array(tile, pa.int32()), list_column(data.astype(np.int32))], names=["frame_id", "stream", "tile_y", "data"])

    return docs.mapInArrow(cut, "frame_id long, stream string, tile_y int, data array<int>")


def text_buffers(docs: DataFrame) -> DataFrame:
    """(name, id, data) of texts (frame_id, stream, text): their tiles as raw frames of 32 x 32 in YUYV, named by stream and numbered 4096 a frame."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, stream, tile, data in _tile_bytes(batches):
            names = ["none" if s is None else s for s in stream]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(frame * 4096 + tile, pa.int64()), pa.array([row.tobytes() for row in data], pa.binary())], names=["name", "id", "data"])

    return docs.mapInArrow(cut, "name string, id long, data binary")


def text_rests(docs: DataFrame) -> DataFrame:
    """(name, id, data): what text_buffers() leaves over of each text, named by stream and -rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-32-le")[::4] for t in b.column(2).to_pylist()]
            rests = [t[len(t) // TILE_BYTES * TILE_BYTES :] for t in texts]
            names = [f"{'none' if s is None else s}-rest" for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column(0), pa.array(rests, pa.binary())], names=["name", "id", "data"])

    return docs.mapInArrow(cut, "name string, id long, data binary")


def frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, stream, text) of documents that hold a tile, dealt over all cores."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= TILE_BYTES)
    return spread(docs.select(F.col("doc_id").cast("long").alias("frame_id"), F.col("lang").alias("stream"), "text"), "frame_id")


def raw_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, stream, tile_y, data): the frames' tiles, 2048 bytes each, cut and decoded in Arrow batches."""
    return tiled_texts(frame_texts(spark, sf_dir))


def text_beats(docs: DataFrame) -> DataFrame:
    """(stream, frame_id, seq, last, end) of texts (frame_id, stream, text): 128 beats a tile, the last of a tile and the end of a frame marked."""
    tiles = docs.select("stream", "frame_id", F.expr(f"char_length(text) div {TILE_BYTES}").alias("k")).where("k > 0")
    beats = tiles.select("stream", "frame_id", "k", F.explode(F.expr("sequence(0L, k * 128 - 1)")).alias("seq"))
    return beats.select("stream", "frame_id", "seq", F.expr("seq % 128 = 127").alias("last"), F.expr("seq = k * 128 - 1").alias("end"))


def explode_yuyv(frames: DataFrame) -> DataFrame:
    """(frame_id, y, x, luma, u, v) of texts (frame_id, stream, text): two pixels of each four bytes share u and v."""

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, _, tile, data in _tile_bytes(batches, 32):
            quad = data.reshape(-1, 4).astype(np.int32)
            n = len(tile) * TILE * TILE
            y, x = np.divmod(np.tile(np.arange(TILE * TILE, dtype=np.int32), len(tile)), TILE)
            columns = [np.repeat(frame, TILE * TILE), y + np.repeat(tile * TILE, TILE * TILE).astype(np.int32), x, quad[:, [0, 2]].reshape(n), np.repeat(quad[:, 1], 2), np.repeat(quad[:, 3], 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["frame_id", "y", "x", "luma", "u", "v"])

    return frames.mapInArrow(pixels, "frame_id long, y int, x int, luma int, u int, v int")


def pixels_yuv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_yuyv(frame_texts(spark, sf_dir))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patch_id, label, pix): embeddings as 8 x 8 tiles of one channel, 0 to 255."""
    pix = "transform(embedding, e -> cast(greatest(0D, least(255D, floor((cast(e as double) + 1D) * 128D))) as int))"
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("patch_id"), "label", F.expr(pix).alias("pix"))


def patch_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patch_id, y, x, v)."""
    return patches(spark, sf_dir).select("patch_id", F.posexplode("pix").alias("i", "v")).select("patch_id", F.expr("i div 8").cast("int").alias("y"), F.expr("i % 8").alias("x"), "v")


def synth_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, stream, texture): what the small frames follow from, one for each order, its texture by priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.expr("o_custkey % 16").alias("stream"), F.expr("cast(substr(o_orderpriority, 1, 1) as int)").alias("texture"))


def synth_luma(size: int = 20) -> Column:
    """The luma of a pixel (frame_id, texture, y, x) of a small frame."""
    luma = F.when(F.col("texture") == 1, (F.col("y") + F.col("x")) % 2 * 255).when(F.col("texture") == 2, (hashed(F.col("frame_id") * 1000 + F.col("y") * size + F.col("x")) % 256).cast("int"))
    return luma.when(F.col("texture") == 3, F.col("x") * 12).when(F.col("texture") == 4, F.col("y") % 4 * 60).otherwise(128).cast("int")


def synth_frames(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """(frame_id, stream, texture, y, x, luma): the small frames by pixel."""
    grid = synth_orders(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("i")).select("frame_id", "stream", "texture", F.expr(f"cast(i div {size} as int)").alias("y"), F.expr(f"i % {size}").alias("x"))
    return grid.withColumn("luma", synth_luma(size))


def byte_matrix(column: pa.Array) -> np.ndarray:
    """(rows, bytes) of a column of binaries of one length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def byte_column(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix of bytes as a column of binaries."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def synth_planes(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """(frame_id, texture, luma): the small frames of synth_frames(), a frame a row, a byte a pixel in raster order."""
    y, x = (i.ravel() for i in np.indices((size, size)))
    fixed = {1: (y + x) % 2 * 255, 3: x * 12, 4: y % 4 * 60}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                texture = b.column("texture").fill_null(0).to_numpy()
                luma = np.full((len(texture), size * size), 128, np.uint8)
                for t, plane in fixed.items():
                    luma[texture == t] = plane
                drawn = np.flatnonzero(texture == 2)
                key = b.column("frame_id").to_numpy()[drawn, None] * 1000 + (y * size + x)
                luma[drawn] = key % 1000003 * 48271 % 2147483647 % 256
                yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("texture"), byte_column(luma)], names=["frame_id", "texture", "luma"])

    return spread(synth_orders(spark, sf_dir).select(F.col("frame_id").cast("long").alias("frame_id"), "texture"), "frame_id").mapInArrow(draw, "frame_id long, texture int, luma binary")


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, stream, status, value)."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("stream"), F.col("event_type").alias("status"), "value")
