"""Tiles go to Python once and leave it as sums: no pixel is shuffled, and few values are held at a time."""

import numpy as np
import pyarrow as pa
import pytest

from framelake.operators import color, resample
from framelake.plans import registry
from framelake.sources import frames as src

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p10_subsample_422", "p14_interleave", "w7_tile_range", "r2_interp_upscale"])
def test_no_pixel_is_shuffled(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "y#" not in plan.replace("tile_y#", "")


def test_kernels_see_few_values_at_once():
    batch = pa.RecordBatch.from_arrays([src.list_column(np.zeros((300, 3072), np.int32))], names=["pix"])
    parts = list(resample._slices(batch, "pix"))
    assert sum(p.num_rows for p in parts) == 300 and max(p.num_rows for p in parts) * 3072 <= resample.VALUES_AT_ONCE


def test_few_texts_are_held_at_once():
    texts = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["en"] * 200), pa.array(["x" * 2048] * 200)], names=["frame_id", "stream", "text"])
    sizes = []

    class Seen:
        num_rows = texts.num_rows

        def slice(self, i, n):
            sizes.append(n)
            return texts.slice(i, n)

    assert sum(len(tile) for _, _, tile, _ in src._tile_bytes([Seen()])) == 200 and max(sizes) <= 64


def test_beats_there_and_back(spark):
    data = [(i * 37 + 11) % 256 for i in range(2048)]
    tiles = spark.createDataFrame([("s", 1, 2, data), (None, 2, 0, data[::-1])], "stream string, frame_id long, tile_y int, data array<int>")
    beats = color.pack_beats(tiles)
    assert "lambda" not in beats._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.frame_id, r.seq): r for r in beats.collect()}
    assert rows[1, 256].data_hex == bytes(data[:16]).hex() and rows[1, 383].last and not rows[1, 382].last and rows[2, 0].stream is None
    back = color.unpack_beats(beats).where("frame_id = 1").orderBy("seq").collect()
    assert [b for r in back for b in r.bytes] == data


def test_intake_of_a_large_table_is_more_files(spark, tmp_path):
    src.table(spark, DATA, "documents").repartition(10).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition for each file
    folders = []
    try:
        named, registry.fresh = registry.fresh, lambda s, name: folders.append(named(s, name)) or folders[-1]
        got = registry.QUERIES["x2_bounded_intake"](spark, str(tmp_path)).collect()
    finally:
        registry.fresh = named
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got[0].epochs == 4 and len(spark.read.parquet(next(f for f in folders if "/intake-" in f)).inputFiles()) == 12
