"""Halos, seams, sections and rectangles against numpy and loops."""

import numpy as np
import pytest

from framelake.operators import nn, tiling


@pytest.mark.parametrize("fill,mode", [("zero", "constant"), ("edge", "edge")])
@pytest.mark.parametrize("rows,columns,size,halo", [(1, 1, 4, 2), (2, 3, 4, 1), (3, 1, 2, 2), (4, 4, 3, 2)])
def test_halos_are_the_frame_around_a_tile(spark, fill, mode, rows, columns, size, halo):
    x = np.random.default_rng(7).integers(0, 256, (3, rows * size, columns * size))
    frames = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(x)], "id int, pix array<int>")
    tiles = tiling.split_tiles(frames, ["id"], "pix", size, rows, columns)
    got = tiling.exchange_halo(tiles, ["id"], size, halo, fill=fill).collect()
    padded = np.pad(x, ((0, 0), (halo, halo), (halo, halo)), mode=mode)
    assert len(got) == 3 * rows * columns
    for r in got:
        y0, x0 = r.tile_y * size, r.tile_x * size
        assert r.pix == padded[r.id, y0 : y0 + size + 2 * halo, x0 : x0 + size + 2 * halo].ravel().tolist()
    back = tiling.join_tiles(tiles, ["id"], "pix", size, rows, columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frames.collect()))


def test_a_convolution_over_tiles_has_no_seams(spark):
    x = np.random.default_rng(1).integers(0, 256, (2, 12, 18))
    w = np.random.default_rng(2).integers(-1000, 1000, (2, 1, 5, 5))
    frames = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(x)], "id int, pix array<int>")
    wide = nn.convolve(tiling.exchange_halo(tiling.split_tiles(frames, ["id"], "pix", 6, 2, 3), ["id"], 6, 2), "pix", "out", 10, w)
    got = tiling.join_tiles(tiling.trim_halo(wide, "out", 6, 2), ["id"], "out", 6, 2, 3, 2).orderBy("id").collect()
    p = np.pad(x, ((0, 0), (2, 2), (2, 2)))
    want = [[[int((p[i, y : y + 5, k : k + 5] * w[o, 0]).sum()) for y in range(12) for k in range(18)] for o in range(2)] for i in range(2)]
    assert [r.out for r in got] == [a + b for a, b in want]


def test_gaps_and_lonely_pieces(spark):
    """A missing tile is no neighbour, and its neighbours' borders don't make one."""
    tiles = spark.createDataFrame([(0, 0, 0, [1] * 4), (0, 0, 2, [3] * 4)], "id int, tile_y int, tile_x int, pix array<int>")
    got = {(r.tile_y, r.tile_x): np.array(r.pix).reshape(4, 4) for r in tiling.exchange_halo(tiles, ["id"], 2, 1).collect()}
    assert set(got) == {(0, 0), (0, 2)} and all(g.sum() == 4 * g[1, 1] for g in got.values())
    assert tiling.exchange_halo(tiles.limit(0), ["id"], 2, 1).count() == 0
    assert tiling.join_tiles(tiles, ["id"], "pix", 2, 1, 3).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5, 7, 9])
def test_phases_equal_the_scattered_kernel(k):
    rng = np.random.default_rng(k)
    x, w = rng.integers(0, 256, (2, 3, 5, 4)).astype(float), rng.integers(-99, 99, (2, 3, k, k)).astype(float)
    assert (nn._conv_phases(x, w) == nn._conv_up(x, w[:, :, ::-1, ::-1])).all()


@pytest.mark.parametrize("cell", [1, 3, 8, 100])
def test_rectangles_find_each_pair_once(spark, cell):
    rng = np.random.default_rng(6)
    rects = [(int(rng.integers(0, 2)), i, *map(int, rng.integers(-6, 12, 2)), *map(int, rng.integers(0, 10, 2))) for i in range(40)]
    rects = [(f, i, y, x, y + h, x + w) for f, i, y, x, h, w in rects]
    df = spark.createDataFrame(rects, "frame int, id int, y0 int, x0 int, y1 int, x1 int")
    points = spark.createDataFrame([(f, y, x) for f in range(2) for y in range(-8, 20) for x in range(-8, 20)], "frame int, y int, x int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = tiling.points_in(points, df, ["frame"], cell)
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
        got = sorted((r.frame, r.y, r.x, r.id) for r in held.collect())
        pairs = sorted((r.frame, r.a, r.b, r.area) for r in tiling.overlaps(df, df, ["frame"], cell).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((f, y, x, i) for f, i, y0, x0, y1, x1 in rects for y in range(y0, y1) for x in range(x0, x1) if -8 <= y < 20 and -8 <= x < 20)
    area = lambda a, b: max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    assert pairs == sorted((a[0], a[1], b[1], area(a, b)) for a in rects for b in rects if a[0] == b[0] and area(a, b))
