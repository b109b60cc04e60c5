"""One-pass routing against the two kernels on their own, and the report that frames bring with them."""

import numpy as np
import pytest

from framelake.operators import nn, resample, router, stats
from framelake.sources import frames as src

FLAT = resample.bilinear_kernel(32, 32, 2, "fixed12")


def tiles(spark, n=23):
    rng = np.random.default_rng(4)
    data = [rng.integers(0, 256, 2048) if i % 3 else 100 + rng.integers(0, 9, 2048) for i in range(n)]
    rows = [(i // 5, "s", i % 5, [int(v) for v in d]) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, "frame_id long, stream string, tile_y int, data array<int>")


def integers():
    return nn.integer_kernel(32, (src.weights_array(5, 2, 3, 3), *src.layer_values(5, 2)), src.weights_array(6, 3, 2, 3))


@pytest.mark.parametrize("override,op,threshold", [(0, ">", 1000), (0, ">=", 5461.5), (1, ">", 1000), (2, ">", 1000)])
def test_each_tile_goes_through_its_own_kernel(spark, override, op, threshold):
    given = tiles(spark)
    got = {(r.frame_id, r.tile_y): r for r in router.upscale_routed(given, resample.rgb_of_yuyv, FLAT, integers(), threshold, override, op, batch=4).collect()}
    want = {(r.frame_id, r.tile_y): r for r in stats.route_tiles(given, threshold, override, op).collect()}
    assert {k: r.route for k, r in got.items()} == {k: r.route for k, r in want.items()}
    for k, r in got.items():
        pixels = resample.rgb_of_yuyv(np.array([want[k].data]))
        assert r.out == (integers() if r.route == "cnn" else FLAT)(pixels)[0].tolist()
        assert r.variance == (None if override else want[k].variance)


def test_plan_has_one_scan_and_one_network_run(spark):
    runs = spark.sparkContext.accumulator(0)

    def network(pixels):
        runs.add(len(pixels))
        return np.zeros((len(pixels), 3 * 64 * 64))

    routed, seen = router.observed(router.upscale_routed(tiles(spark), resample.rgb_of_yuyv, FLAT, network))
    frames = router.whole_frames(routed, 64, 64)
    rows = frames.collect()
    cnn = sum(r.n_cnn for r in rows)
    assert runs.value == cnn and seen.get == {"tiles": 23, "cnn": cnn, "interp": 23 - cnn} and 0 < cnn < 23
    assert frames._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow") == 2  # routing, and packing of words
    for r in rows:
        assert (r.n_tiles, r.n_cnn + r.n_interp, r.width, r.height) == (len(r.tiles), len(r.tiles), 64, 64 * len(r.tiles)) and len(r.data) == r.width * r.height
        assert [t.tile_y for t in r.tiles] == list(range(len(r.tiles))) and sum(t.route == "cnn" for t in r.tiles) == r.n_cnn


def test_routing_of_nothing(spark):
    assert router.whole_frames(router.upscale_routed(tiles(spark).limit(0), resample.rgb_of_yuyv, FLAT, integers()), 64, 64).count() == 0


def test_integer_network_against_plain_sums():
    (w, bias, slopes), up = (src.weights_array(5, 2, 3, 3), *src.layer_values(5, 2)), src.weights_array(6, 3, 2, 3)
    x = np.random.default_rng(1).integers(0, 256, (1, 3, 6, 6))
    mid = np.zeros((2, 6, 6), np.int64)
    for o, y, k in np.ndindex(2, 6, 6):
        s = int(bias[o]) + sum(int(x[0, c, y + i - 1, k + j - 1]) * int(w[o, c, i, j]) for c, i, j in np.ndindex(3, 3, 3) if 0 <= y + i - 1 < 6 and 0 <= k + j - 1 < 6)
        mid[o, y, k] = (s * 4096 if s >= 0 else s * int(slopes[o])) >> 24
    out = np.zeros((3, 12, 12), np.int64)
    for o, c, y, k, i, j in np.ndindex(3, 2, 6, 6, 3, 3):
        if 0 <= 2 * y + i - 1 < 12 and 0 <= 2 * k + j - 1 < 12:
            out[o, 2 * y + i - 1, 2 * k + j - 1] += int(mid[c, y, k]) * int(up[o, c, i, j])
    got = nn.integer_kernel(6, (w, bias, slopes), up)(x.reshape(1, -1))
    assert (got.reshape(3, 12, 12) == np.clip(out >> 12, 0, 255)).all()
