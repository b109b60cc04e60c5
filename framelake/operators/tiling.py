"""Tiles and frame geometry. Pixels meet tiles by an equi-join on candidate tile numbers, never by a range scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tile_grid(frames: DataFrame, size: int, edge: str = "shift") -> DataFrame:
    """frames (with w, h) by tile: tile_y, tile_x, src_y, src_x, tw, th. The last tiles are shifted inside or cut short."""
    n = lambda d: f"cast(ceil({d} / {size}D) as int)"
    grid = frames.withColumn("tile_y", F.explode(F.expr(f"sequence(0, {n('h')} - 1)"))).withColumn("tile_x", F.explode(F.expr(f"sequence(0, {n('w')} - 1)")))
    if edge == "shift":
        return grid.withColumns({"src_y": F.expr(f"greatest(0, least(tile_y * {size}, h - {size}))"), "src_x": F.expr(f"greatest(0, least(tile_x * {size}, w - {size}))"), "tw": F.expr(f"least({size}, w)"), "th": F.expr(f"least({size}, h)")})
    return grid.withColumns({"src_y": F.expr(f"tile_y * {size}"), "src_x": F.expr(f"tile_x * {size}"), "tw": F.expr(f"least({size}, w - tile_x * {size})"), "th": F.expr(f"least({size}, h - tile_y * {size})")})


def crop_tiles(pixels: DataFrame, w: int, h: int, size: int, edge: str = "shift") -> DataFrame:
    """pixels by tile, with tile_y, tile_x and the place in the tile (ty, tx); a pixel is in up to four shifted tiles.

    Which tiles hold a pixel follows from its place, so this needs no join and no shuffle.
    """

    def tiles(c: str, n: int) -> str:
        last = -(-n // size) - 1
        own = f"struct(cast({c} div {size} as int) as t, cast({c} % {size} as int) as p)"
        if edge != "shift" or n % size == 0 or last == 0:
            return f"array({own})"
        start = n - size
        shifted = f"struct({last} as t, cast({c} - {start} as int) as p)"
        return f"case when {c} div {size} = {last} then array({shifted}) when {c} >= {start} then array({own}, {shifted}) else array({own}) end"

    out = pixels.withColumn("_y", F.explode(F.expr(tiles("y", h)))).withColumn("_x", F.explode(F.expr(tiles("x", w))))
    return out.select(*pixels.columns, F.col("_y.t").alias("tile_y"), F.col("_x.t").alias("tile_x"), F.col("_y.p").alias("ty"), F.col("_x.p").alias("tx"))


def drop_letterbox(grid: DataFrame, n_rows: str, top: int = 2, bottom: int = 2) -> DataFrame:
    """grid without its first and last tile rows; n_rows names the column with the number of tile rows."""
    return grid.where((F.col("tile_y") >= top) & (F.col("tile_y") < F.col(n_rows) - bottom))


def row_extents(grid: DataFrame, bpp: int, out_bpp: int, scale: int, stride: int, x0: int, y0: int) -> DataFrame:
    """Byte offsets of each row of each tile in the source and at (x0, y0) in a buffer of such a stride; tiles that begin before the buffer go."""
    rows = grid.withColumn("row", F.explode(F.expr("sequence(0, th - 1)")))
    src = F.expr(f"cast((src_y + row) * w + src_x as bigint) * {bpp}")
    dst = F.expr(f"cast((src_y + row) * {scale} + {y0} as bigint) * {stride} + (src_x * {scale} + {x0}) * {out_bpp}")
    begin = F.expr(f"cast(src_y * {scale} + {y0} as bigint) * {stride} + (src_x * {scale} + {x0}) * {out_bpp}")
    return rows.withColumns({"src_offset": src, "src_bytes": F.expr(f"tw * {bpp}"), "dst_offset": dst, "begin": begin}).where("begin >= 0").drop("begin")


def halo_sections(pixels: DataFrame, keys: list[str], h: int, w: int, rows: int, halo: int, fill: int = 0) -> DataFrame:
    """Strips of `rows` rows with halo rows on each side: section, sy, x, v; what lies outside is fill."""
    n = -(-h // rows)
    place = f"sequence(greatest(0, cast(ceil((y - {rows + halo - 1}) / {rows}D) as int)), least({n - 1}, (y + {halo}) div {rows}))"
    inside = pixels.select(*keys, "y", "x", "v", F.explode(F.expr(f"cast({place} as array<int>)")).alias("section")).select(*keys, "section", F.expr(f"cast(y - section * {rows} + {halo} as int)").alias("sy"), "x", "v")
    if not halo:
        return inside
    edge = pixels.where((F.col("y") == 0) | (F.col("y") == h - 1))
    outside = F.when(F.col("y") == 0, F.expr(f"transform(sequence(0, {halo - 1}), i -> struct(0 as section, i as sy))")).otherwise(F.expr(f"transform(sequence({h - (n - 1) * rows + halo}, {h - (n - 1) * rows + 2 * halo - 1}), i -> struct({n - 1} as section, i as sy))"))
    return inside.unionByName(edge.select(*keys, "x", F.inline(outside)).select(*keys, "section", "sy", "x", F.lit(fill).cast(pixels.schema["v"].dataType).alias("v")))


def stitch(tiles: DataFrame, size: int, w: int, h: int, order: str = "column", scale: int = 1) -> DataFrame:
    """(frame_id, y, x, v) of cropped tiles shifted inside at the edges; where tiles overlap the last in write order wins.

    order 'column' writes tile columns from left to right, 'row' tile rows from top to bottom.
    """
    seq = "tile_x * 65536 + tile_y" if order == "column" else "tile_y * 65536 + tile_x"
    at = lambda t, p, n: f"cast(greatest(0, least({t} * {size}, {n} - {size})) * {scale} + {p} as int)"
    placed = tiles.select("frame_id", F.expr(at("tile_y", "ty", h)).alias("y"), F.expr(at("tile_x", "tx", w)).alias("x"), "v", F.expr(seq).alias("seq"))
    return placed.groupBy("frame_id", "y", "x").agg(F.max_by("v", "seq").alias("v"))


def unflatten(df: DataFrame, width: int, channels: int = 1) -> DataFrame:
    """y, x, c of a flat index i."""
    return df.withColumns({"y": F.expr(f"cast(i div {width * channels} as int)"), "x": F.expr(f"cast((i div {channels}) % {width} as int)"), "c": F.expr(f"cast(i % {channels} as int)")})


def flatten(df: DataFrame, width: int, channels: int = 1) -> DataFrame:
    return df.withColumn("i", F.expr(f"(y * {width} + x) * {channels} + c"))


def overlay(pixels: DataFrame, size: int, kind: str = "dot", value: int = 255) -> DataFrame:
    """pixels with tile origins dotted, tiles outlined or discs at tile centres, drawn by place alone."""
    masks = {
        "dot": f"y % {size} = 0 and x % {size} = 0",
        "outline": f"y % {size} in (0, {size - 1}) or x % {size} in (0, {size - 1})",
        "disc": f"power(y % {size} - {size // 2}, 2) + power(x % {size} - {size // 2}, 2) <= {(size // 4) ** 2}",
    }
    return pixels.withColumn("luma", F.when(F.expr(masks[kind]), value).otherwise(F.col("luma")))


def pixel_shuffle(fmap: DataFrame, r: int) -> DataFrame:
    """r * r channels as one map of r times the size: (patch_id, c, y, x, v)."""
    return fmap.select("patch_id", F.expr(f"cast(c div {r * r} as int)").alias("c"), F.expr(f"cast(y * {r} + (c % {r * r}) div {r} as int)").alias("y"), F.expr(f"cast(x * {r} + c % {r} as int)").alias("x"), "v")


def crop(pixels: DataFrame, size: int, side: int, y0: str, x0: str) -> DataFrame:
    """A side x side window of each size x size tile from (y0, x0), expressions of its row."""
    moved = pixels.withColumns({"_y": F.expr(f"cast(y - ({y0}) as int)"), "_x": F.expr(f"cast(x - ({x0}) as int)")})
    inside = moved.where(f"_y between 0 and {side - 1} and _x between 0 and {side - 1}")
    return inside.drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def rotate90(pixels: DataFrame, k: str, size: int) -> DataFrame:
    """Square tiles turned k times by 90 degrees counter-clockwise; k is an expression of the row."""
    turned = {"_y": F.expr(f"case pmod({k}, 4) when 0 then y when 1 then {size - 1} - x when 2 then {size - 1} - y else x end"), "_x": F.expr(f"case pmod({k}, 4) when 0 then x when 1 then y when 2 then {size - 1} - x else {size - 1} - y end")}
    return pixels.withColumns(turned).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


def stitch_rows(tiles: DataFrame, out: str, w: int, h: int) -> DataFrame:
    """(frame_id, width, height, data) of frames one tile wide: their tiles' planes (w x h values in out) one below the other, a frame a row."""
    ordered = F.array_sort(F.collect_list(F.struct("tile_y", out)))
    whole = tiles.groupBy("frame_id").agg(F.flatten(F.transform(ordered, lambda x: x[out])).alias("data"), (F.count("*") * h).cast("int").alias("height"))
    return whole.select("frame_id", F.lit(w).alias("width"), "height", "data")


# --- halos between tiles -----------------------------------------------------------------------


def _border(tile: np.ndarray, d: int, halo: int, axis: int) -> np.ndarray:
    """What a neighbour in direction d needs of (n, h, w) tiles: the last rows or columns for one below or to the right, the first for one above or to the left."""
    n = tile.shape[axis]
    return tile if not d else np.take(tile, np.arange(n - halo, n) if d > 0 else np.arange(halo), axis)


def exchange_halo(tiles: DataFrame, keys: list[str], size: int, halo: int, pix: str = "pix", fill: str = "zero") -> DataFrame:
    """(keys, tile_y, tile_x, pix) with pix widened by the halo pixels of the eight neighbours, to size + 2 * halo on each side.

    Where there is no neighbour the border is zero, or with fill 'edge' repeats the frame's outermost
    pixels. A tile is sent whole to itself and by its borders to its neighbours, so what is shuffled is
    the tiles and 4 * halo * (size + halo) values more for each; at most nine pieces meet in a row.
    """
    kind = tiles.schema[pix].dataType.elementType
    dtype = {"int": np.int32, "bigint": np.int64, "double": np.float64}[kind.simpleString()]
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    fields = [tiles.schema[k] for k in keys]
    sent = T.StructType([*fields, T.StructField("tile_y", T.IntegerType()), T.StructField("tile_x", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("piece", T.ArrayType(kind))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(pix).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size)
            y_, x_ = (b.column(c).to_numpy() for c in ("tile_y", "tile_x"))
            for i, (dy, dx) in enumerate(around):  # the piece stands at (-dy, -dx) of the neighbour
                piece = _border(_border(x, dy, halo, 1), dx, halo, 2).reshape(len(x), -1)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * piece.shape[1])
                values = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(piece).ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array((y_ + dy).astype(np.int32)), pa.array((x_ + dx).astype(np.int32)), pa.array(np.full(len(x), i, np.int32)), values], names=sent.names)

    pieces = tiles.select(*keys, "tile_y", "tile_x", pix).mapInArrow(send, sent).groupBy(*keys, "tile_y", "tile_x")
    met = pieces.agg(F.map_from_entries(F.collect_list(F.struct("at", "piece"))).alias("pieces")).where("pieces[4] is not null")  # pieces for tiles that are there
    met = met.select(*keys, "tile_y", "tile_x", *[F.col("pieces")[i].alias(f"p{i}") for i in range(9)])
    wide = size + 2 * halo
    out = T.StructType([*fields, T.StructField("tile_y", T.IntegerType()), T.StructField("tile_x", T.IntegerType()), T.StructField(pix, T.ArrayType(kind))])
    span = {-1: slice(0, halo), 0: slice(halo, halo + size), 1: slice(halo + size, wide)}

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, there = np.zeros((b.num_rows, wide, wide), dtype), {}
            for i, (dy, dx) in enumerate(around):
                column, to = b.column(f"p{i}"), (-dy, -dx)
                there[to] = column.is_valid().to_numpy(zero_copy_only=False)
                part = column.drop_null().flatten().to_numpy(zero_copy_only=False)
                h, w = (size if not d else halo for d in to)
                x[there[to], span[to[0]], span[to[1]]] = part.reshape(-1, h, w)
            if fill == "edge":
                for d, edge in ((-1, halo), (1, halo + size - 1)):
                    alone = ~there[d, 0]
                    x[alone, span[d], :] = x[alone, edge : edge + 1, :]
                for d, edge in ((-1, halo), (1, halo + size - 1)):
                    alone = ~there[0, d]
                    x[alone, :, span[d]] = x[alone, :, edge : edge + 1]
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * wide * wide)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keys, "tile_y", "tile_x")], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=out.names)

    return met.mapInArrow(widen, out)


def trim_halo(df: DataFrame, col: str, size: int, halo: int) -> DataFrame:
    """df with the halo taken off each channel plane in col."""
    wide = size + 2 * halo
    inner = f"flatten(transform(sequence(0, size({col}) div {wide * wide} * {size} - 1), r -> slice({col}, cast((r div {size}) * {wide * wide} + (r % {size} + {halo}) * {wide} + {halo + 1} as int), {size})))"
    return df.withColumn(col, F.expr(inner))


def join_tiles(tiles: DataFrame, keys: list[str], col: str, size: int, rows: int, columns: int, channels: int = 1) -> DataFrame:
    """(keys, col) of frames put together from rows x columns tiles (keys, tile_y, tile_x, col), channel by channel in raster order; a frame that lacks a tile is left out."""
    whole = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tile_y", "tile_x", col))).alias("t")).where(F.size("t") == rows * columns)
    n = rows * size
    line = f"transform(slice(t, cast((i % {n} div {size}) * {columns} + 1 as int), {columns}), k -> slice(k.{col}, cast((i div {n}) * {size * size} + (i % {size}) * {size} + 1 as int), {size}))"
    plane = f"flatten(transform(sequence(0, {n * channels - 1}), i -> flatten({line})))"
    return whole.select(*keys, F.expr(plane).alias(col))


def split_tiles(df: DataFrame, keys: list[str], pix: str, size: int, rows: int, columns: int) -> DataFrame:
    """(keys, tile_y, tile_x, pix) of frames of rows x columns tiles held in raster order."""
    width = columns * size
    line = f"slice({pix}, cast((ty * {size} + r) * {width} + tx * {size} + 1 as int), {size})"
    tile = f"struct(cast(ty as int) as tile_y, cast(tx as int) as tile_x, flatten(transform(sequence(0, {size - 1}), r -> {line})) as {pix})"
    cut = f"flatten(transform(sequence(0, {rows - 1}), ty -> transform(sequence(0, {columns - 1}), tx -> {tile})))"
    return df.select(*keys, F.inline(F.expr(cut)))


def join_sections(sections: DataFrame, keys: list[str], rows: int, halo: int) -> DataFrame:
    """(keys, y, x, v) of strips (keys, section, sy, x, v) as halo_sections() makes them: halo rows go, sections come together again."""
    inside = sections.where(f"sy >= {halo} and sy < {rows + halo}")
    return inside.select(*keys, F.expr(f"cast(section * {rows} + sy - {halo} as int)").alias("y"), "x", "v")


# --- rectangles --------------------------------------------------------------------------------


def _cells(lo: str, hi: str, cell: int) -> str:
    return f"sequence(cast(floor({lo} / {cell}D) as int), cast(floor(({hi} - 1) / {cell}D) as int))"


def points_in(points: DataFrame, rectangles: DataFrame, keys: list[str], cell: int = 8) -> DataFrame:
    """points (keys, y, x, ...) with the columns of each rectangle (keys, y0, x0, y1, x1, ...; ends excluded) that holds them.

    A rectangle is listed under each cell of a grid that it touches, a point has one cell, so keys and
    cell are an equi-join that finds each pair once; what is left is a filter. Empty rectangles hold
    nothing. Cells should be about as large as common rectangles: small ones list large rectangles
    often, large ones meet points that no rectangle holds. Names other than keys must differ.
    """
    listed = rectangles.where("y0 < y1 and x0 < x1").withColumn("cell_y", F.explode(F.expr(_cells("y0", "y1", cell)))).withColumn("cell_x", F.explode(F.expr(_cells("x0", "x1", cell))))
    placed = points.withColumns({"cell_y": F.expr(f"cast(floor(y / {cell}D) as int)"), "cell_x": F.expr(f"cast(floor(x / {cell}D) as int)")})
    return placed.join(listed, [*keys, "cell_y", "cell_x"]).where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("cell_y", "cell_x")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 8) -> DataFrame:
    """(keys, a, b, area): pairs of rectangles (keys, id, y0, x0, y1, x1) of a and b that share pixels, each pair once.

    Both are listed by the cells that they touch. A pair meets in each cell that both touch and counts
    in the one that holds the first pixel that they share.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        df = df.where("y0 < y1 and x0 < x1").withColumn("cell_y", F.explode(F.expr(_cells("y0", "y1", cell)))).withColumn("cell_x", F.explode(F.expr(_cells("x0", "x1", cell))))
        return df.select(*keys, "cell_y", "cell_x", F.struct("id", "y0", "x0", "y1", "x1").alias(name))

    met = listed(a, "l").join(listed(b, "r"), [*keys, "cell_y", "cell_x"])
    met = met.withColumns({f"{c}0": F.greatest(f"l.{c}0", f"r.{c}0") for c in "yx"} | {f"{c}1": F.least(f"l.{c}1", f"r.{c}1") for c in "yx"})
    first = " and ".join(f"cell_{c} = cast(floor({c}0 / {cell}D) as int)" for c in "yx")
    return met.where(f"y0 < y1 and x0 < x1 and {first}").select(*keys, F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.expr("(y1 - y0) * (x1 - x0)").alias("area"))
