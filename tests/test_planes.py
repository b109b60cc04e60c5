"""Frames held whole: the same pixels and tiles as by rows of pixels, and no row for each pixel."""

import numpy as np
import pytest

from framelake.operators import planes, tiling
from framelake.plans import registry
from framelake.sources import frames as src

DATA = "/root/testdata/sf0.001"


def test_frames_held_whole_are_those_by_pixel(spark):
    pixels = {}
    for r in src.synth_frames(spark, DATA).where("frame_id < 60").collect():
        pixels.setdefault(r.frame_id, np.zeros((20, 20), int))[r.y, r.x] = r.luma
    whole = {r.frame_id: np.frombuffer(r.luma, np.uint8).reshape(20, 20) for r in src.synth_planes(spark, DATA).where("frame_id < 60").collect()}
    assert whole.keys() == pixels.keys() and all((whole[k] == pixels[k]).all() for k in whole)


@pytest.mark.parametrize("order", ["column", "row"])
def test_tiles_laid_are_those_stitched_by_pixel(spark, order):
    px = src.synth_frames(spark, DATA).where("frame_id = 1").withColumn("v", src.synth_luma())
    tiles = tiling.crop_tiles(px, 20, 20, 8).selectExpr("*", "v + tile_x * 50 + tile_y * 7 as w").drop("v").withColumnRenamed("w", "v")
    want = np.zeros((20, 20), int)
    for r in tiling.stitch(tiles, 8, 20, 20, order).collect():
        want[r.y, r.x] = r.v
    frame = np.frombuffer(src.synth_planes(spark, DATA).where("frame_id = 1").first().luma, np.uint8).reshape(1, 20, 20)
    added = (np.arange(3)[:, None] * 7 + np.arange(3) * 50)[:, :, None, None]
    assert (planes.lay(planes.cut(frame, 8) + added, 20, 20, order)[0] == want).all()


@pytest.mark.parametrize("name", ["g6_halo_frames", "g7_stitch", "r2_adaptive_grid", "w6_overlap_column", "w6_overlap_row"])
def test_no_row_for_each_pixel(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_regions_meet_frames_before_pixels_are_drawn(spark):
    plan = registry.QUERIES["j3_region_pixels"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # the join is below
