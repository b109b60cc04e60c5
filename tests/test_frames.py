"""Hand values, round trips and equivalences of the frame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import color, nn, resample, stats, tiling
from framelake.sources import frames as src


def yuyv(spark, luma):
    """One 32 x 32 tile with u = v = 128."""
    data = [x for p in luma for x in (p, 128)]
    return spark.createDataFrame([(1, "s", 0, data)], "frame_id long, stream string, tile_y int, data array<int>")


def test_variance_hand_values(spark):
    ramp = [[(4 * (i // 2) + (i % 2)) % m for i in range(1024)] for m in (256, 10)]
    checker = [(i + i // 32) % 2 * 255 for i in range(1024)]
    got = stats.tile_variance(yuyv(spark, checker)).first()
    assert got.variance == 16256.5
    assert stats.tile_variance(yuyv(spark, checker), wrap=True).first().variance == -127.5
    for luma in ramp:
        mean = sum(luma) // 1024
        row = stats.route_tiles(yuyv(spark, luma)).first()
        assert row.var_num == sum((x - mean) ** 2 for x in luma) and row.route == ("cnn" if row.variance > 1000 else "interp")


def test_grid_counts_and_letterbox(spark):
    frame = spark.createDataFrame([(1, 720, 576)], "frame_id int, w int, h int")
    grid = tiling.tile_grid(frame, 32)
    assert grid.count() == 414 and tiling.drop_letterbox(grid.withColumn("n", F.lit(18)), "n").count() == 322
    edge = tiling.tile_grid(frame, 28).agg(F.max("src_x"), F.max("src_y")).first()
    assert tuple(edge) == (692, 548)


def test_override_reads_no_variance(spark):
    plan = stats.route_tiles(yuyv(spark, [0] * 1024), override=1).select("frame_id", "route")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_stitch_of_crop_is_identity(spark):
    px = spark.range(23 * 17).select(F.lit(1).alias("frame_id"), F.expr("cast(id div 23 as int)").alias("y"), F.expr("cast(id % 23 as int)").alias("x"), (F.col("id") * 7 % 256).alias("v"))
    back = tiling.stitch(tiling.crop_tiles(px, 23, 17, 8), 8, 23, 17)
    assert back.exceptAll(px.select("frame_id", "y", "x", "v")).count() == 0 and back.count() == px.count()


def test_transposed_equals_zero_inserted(spark):
    m = spark.range(2 * 36).select(F.expr("id div 36").alias("patch_id"), F.lit(0).alias("c"), F.expr("cast(id % 36 div 6 as int)").alias("y"), F.expr("cast(id % 6 as int)").alias("x"), (F.col("id") * 31 % 97).alias("v"))
    w = src.weights_table(spark, 2, 2, 1, 5)
    a = nn.conv_transpose2d(m, w, 5, 6)
    b = nn.conv2d(nn.zero_insert(m, 2, 6), w.withColumns({"ky": 4 - F.col("ky"), "kx": 4 - F.col("kx")}), 5, 12)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 2 * 2 * 144


def test_fixed_ratio_and_tolerance():
    assert [(n - 1) * 4096 // (2 * n - 1) for n in (32, 28)] == [2015, 2010]
    assert all(abs(sum(w for _, w in row) - 1) < 1e-9 for kind in ("cubic", "lanczos") for row in resample.axis_taps(8, 4, kind))


def test_words_round_trip(spark):
    px = spark.createDataFrame([(1, 0, 0, 255, 0, 17)], "frame_id int, y int, x int, r int, g int, b int")
    assert color.unpack_words(color.pack_words(px).drop("r", "g", "b")).select("r", "g", "b").first() == (255, 0, 17)
    assert color.pack_rgb565(px).first().rgb565 == (255 >> 3 << 11) | (17 >> 3)


def test_registered_queries_have_names_and_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("mode", ["align", "origin", "half_pixel", "fixed12"])
def test_bilinear_keeps_constant_tiles(spark, mode):
    tile = spark.createDataFrame([([9] * 16,)], "pix array<int>")
    up = set(resample.upscale_bilinear(tile, "pix", "up", 4, 4, 2, mode).first().up)
    assert up <= {8, 9} if mode == "fixed12" else up == {9}


def test_texts_are_cut_into_tiles(spark, tmp_path):
    texts = ["aé\n€ z" * 1400, "x" * 2047, "y" * 2048, "", None, "ab\r\n" * 1024]
    rows = [(i, x, "en", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.frame_id, r.tile_y): list(r.data) for r in src.raw_tiles(spark, str(tmp_path)).collect()}
    want = {(i, t): [ord(c) % 256 for c in x[2048 * t : 2048 * (t + 1)]] for i, x, _, n in rows for t in range(n // 2048)}
    assert got == want and len(want) == 7
    pixels = src.pixels_yuv(spark, str(tmp_path))
    assert pixels.count() == 7 * 1024
    one = pixels.where("frame_id = 0 and y = 33 and x = 5").first()
    data = want[0, 1]
    assert (one.luma, one.u, one.v) == (data[64 + 10], data[64 + 9], data[64 + 11])


@pytest.mark.parametrize("spec", list(nn.SPECS))
def test_networks_against_plain_sums(spec):
    rng = np.random.default_rng(3)
    for (kind, i, o, k), layer in zip(nn.SPECS[spec], nn.network_weights(nn.SPECS[spec]), strict=True):
        if kind not in ("conv", "up"):
            continue
        w = layer[0]
        if w.size > 10_000:
            w = w[:3]
            o = 3
        x = rng.random((2, i, 6, 6)).astype(np.float32)
        wide = x if kind != "up" else np.zeros((2, i, 12, 12), np.float32)
        if kind == "up":
            wide[:, :, ::2, ::2] = x
        p = np.pad(wide, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
        size = wide.shape[2]
        want = np.array([[[(p[:, :, y : y + k, z : z + k] * w[c]).sum((1, 2, 3)) for z in range(size)] for y in range(size)] for c in range(o)]).transpose(3, 0, 1, 2)
        got = nn._conv_up(x, w) if kind == "up" else nn._conv(x, w)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)


def test_networks_do_not_die_out():
    x = np.random.default_rng(5).random((1, 1, 32, 32)).astype(np.float32)
    for spec, channels in (("small", 3), ("luma", 1)):
        y = nn.run_network(np.repeat(x, channels, 1), nn.SPECS[spec], nn.network_weights(nn.SPECS[spec]))
        assert y.shape[2:] == (64, 64) and 0 <= y.mean() <= 1 and np.ptp(y) > 25 / 256


def test_report_names_round_halves_to_even(spark):
    rows = [(1, 0, "interp", 12.125), (1, 1, "cnn", 12.375)]
    names = [r.name for r in stats.tile_report(spark.createDataFrame(rows, "frame_id long, tile_y int, route string, variance double")).orderBy("tile_y").collect()]
    assert names == ["crop_0_0_interp_var12.12", "crop_1_0_cnn_var12.38"]


def test_places_of_a_million_rows_under_default_settings(spark):
    """Each place once, in order, with the rows' other columns, although partitions are merged and sampled as they come."""
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.concat(F.lit("payload-"), F.col("id").cast("string")).alias("a.b"), F.array("id", "id").alias("row"))
    got = src.numbered(rows, ["k"])
    assert got.columns == ["k", "a.b", "row", "pos"]
    seen = got.agg(F.count("*"), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.countDistinct("`a.b`")).first()
    assert tuple(seen) == (1_000_000, 1_000_000, 0, 999_999, 1_000_000)
    by = got.orderBy("pos").select("k").toPandas()["k"].to_numpy()
    assert (np.diff(by) > 0).all()
    pairs = src.zip_by_position(rows.select("k"), rows.select((F.col("k") * 2).alias("j")), ["k"], ["j"])
    assert pairs.where("j = 2 * k").count() == 1_000_000


def test_names_sort_by_all_their_numbers(spark):
    names = ["a2b10.png", "a2b9.png", "a10b1.png", "a02b9.png", "b1.png", "12345678901234567890123.png", "9.png", "a.png", "a1", "a"]
    got = {r.name: r["rank"] for r in stats.natural_rank(spark.createDataFrame([(x,) for x in names], "name string"), "name").collect()}
    assert sorted(got, key=got.get) == ["9.png", "12345678901234567890123.png", "a", "a1", "a02b9.png", "a2b9.png", "a2b10.png", "a10b1.png", "a.png", "b1.png"]


def test_a_layer_in_tiles_is_the_layer_over_rows(spark):
    """Convolution and transposed convolution, with bias and slopes, against joins of pixels and weights."""
    tiles = spark.range(3).select(F.col("id").alias("patch_id"), F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (i * 37 + F.col("id") * 11) % 256).alias("pix"))
    rows = tiles.select("patch_id", F.posexplode("pix").alias("i", "v")).select("patch_id", F.expr("cast(i div 36 as int)").alias("c"), F.expr("cast(i % 36 div 6 as int)").alias("y"), F.expr("cast(i % 6 as int)").alias("x"), F.col("v").cast("long"))
    table, array = src.weights_table(spark, 2, 3, 2, 5), src.weights_array(2, 3, 2, 5)
    assert [r.w for r in table.orderBy("out_ch", "in_ch", "ky", "kx").collect()] == array.ravel().tolist()
    for up, size, made in ((False, 6, nn.conv2d(rows, table, 5, 6)), (True, 12, nn.conv_transpose2d(rows, table, 5, 6))):
        out = nn.convolve(tiles, "pix", "out", 6, array, up=up).select("patch_id", F.posexplode("out").alias("i", "v"))
        placed = out.select("patch_id", F.expr(f"cast(i div {size * size} as int)").alias("c"), F.expr(f"cast(i % {size * size} div {size} as int)").alias("y"), F.expr(f"cast(i % {size} as int)").alias("x"), "v")
        assert placed.exceptAll(made.select(placed.columns)).count() == 0 and placed.count() == made.count() == 3 * 3 * size * size
    bias, slopes = src.layer_values(2, 3)
    plain, whole = (nn.convolve(tiles, "pix", "out", 6, array, *x).orderBy("patch_id").toPandas()["out"] for x in ((), (bias, slopes)))
    for a, b in zip(plain, whole, strict=True):
        v = np.array(a).reshape(3, 36) + bias[:, None]
        assert (np.where(v >= 0, v * 4096, v * slopes[:, None]).ravel() == np.array(b)).all()


def test_fixed_point_network_stays_near_the_float_one():
    x = np.random.default_rng(2).random((4, 3, 8, 8))
    weights = nn.network_weights(nn.SMALL)
    exact, fixed = nn.run_network(x, nn.SMALL, weights), nn.run_network(x, nn.SMALL, weights, 12)
    assert 0 < np.abs(exact - fixed).max() * 256 < 24 and np.abs(exact - fixed).mean() * 256 < 3


def test_residual_network_adds_once_around_its_mapping_layers():
    """By hand: 7 layers, the sum with what came out of them after 6 more, the last one, pixels from channels."""
    x = np.random.default_rng(4).random((1, 3, 4, 4)).astype(np.float32)
    weights = nn.network_weights(nn.RESIDUAL)
    layers = [w for w in weights if w]
    assert len(layers) == 14 and all((a == 0).all() for _, _, a in layers)
    y = x
    for w, b, _ in layers[:7]:
        y = np.maximum(0, nn._conv(y, w) + b[:, None, None])
    kept = y
    for w, b, _ in layers[7:13]:
        y = np.maximum(0, nn._conv(y, w) + b[:, None, None])
    y = nn._conv(y + kept, layers[13][0])
    want = np.array([[[y[0, c * 4 + r % 2 * 2 + k % 2, r // 2, k // 2] for k in range(8)] for r in range(8)] for c in range(3)])
    assert np.allclose(nn.run_network(x, nn.RESIDUAL, weights)[0], want, rtol=1e-3, atol=1e-4)


def test_a_stream_obeys_its_control_table_as_it_changes(spark, tmp_path):
    """Each trigger reads threshold and override again."""
    from framelake.streaming import frames as streams

    tiles = yuyv(spark, [(i * 7) % 256 for i in range(1024)])
    for i in range(3):
        tiles.withColumn("frame_id", F.lit(i).cast("long")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    settings = iter([(1e9, 0), (0.0, 0), (1e9, 1)])
    control = lambda: spark.createDataFrame([(1, *next(settings))], "since long, threshold double, override int")
    stream = streams.read_frame_stream(spark, f"{tmp_path}/in", tiles.schema, 1)
    streams.stream_route(stream, control, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [r.n_cnn for r in spark.read.parquet(f"{tmp_path}/out").orderBy("epoch").collect()] == [0, 1, 1]


def test_noise_spreads_as_a_normal_draw_and_bleed_keeps_sums(spark):
    from framelake.operators import augment

    flat = spark.range(300).select(F.col("id").alias("patch_id"), F.array_repeat(F.lit(128), 64).alias("pix"))
    noisy = np.stack(augment.add_noise(flat, "pix", "patch_id", 4.0, "n").toPandas()["n"].to_list()).astype(float) - 128
    assert abs(noisy.mean()) < 0.2 and abs(noisy.std() - 4) < 0.3
    made = augment.augment(flat, "patch_id", "pix", 8, 8).toPandas()
    assert len(made) == 900 and {int(v) for x in made["augmented"] for v in x} <= set(range(256))
    plain = made[(made["bright"] == 0) & (made["contrast"] == 1.0)]
    assert len(plain) and all(set(x) == {128} for x in plain["augmented"])  # sharpness and maps leave a flat tile alone


def test_colour_bleeds_along_rows_and_leaves_luma(spark):
    import numpy as np
    from framelake.operators import augment

    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (5, 3, 4, 6))
    df = spark.createDataFrame([(k, x.ravel().tolist()) for k, x in enumerate(rgb)], "k int, planes array<int>")
    made = np.stack(augment.bleed_rgb(df, "planes", "out", 6, 4).orderBy("k").toPandas()["out"].to_list()).reshape(rgb.shape)
    weights = np.array(augment.RGB_TO_YUV)
    yuv, soft = np.einsum("ij,njyx->niyx", weights, rgb), np.einsum("ij,njyx->niyx", weights, made)
    assert np.allclose(soft[:, 0], yuv[:, 0], atol=0.6) and np.abs(np.diff(soft[:, 1:], axis=3)).max() < np.abs(np.diff(yuv[:, 1:], axis=3)).max() / 4
    assert np.allclose(soft[:, 1:].mean(3), yuv[:, 1:].mean(3), atol=1)  # reflected edges keep a row's mean
    flat = spark.createDataFrame([(0, [9] * 24 + [200] * 24 + [77] * 24)], "k int, planes array<int>")
    assert np.allclose(augment.bleed_rgb(flat, "planes", "out", 6, 4).first().out, [9] * 24 + [200] * 24 + [77] * 24, atol=0.5)


def test_jitter_turns_hue_and_leaves_grey(spark):
    import colorsys

    from framelake.operators import augment

    df = spark.createDataFrame([(k, [210] * 9 + [40] * 9 + [90] * 9) for k in range(60)] + [(99, [130] * 27)], "k long, planes array<int>")
    for r in augment.jitter_rgb(df, "k", "planes", "out", 3, 3).collect():
        if r.k == 99:
            assert set(r.out) == {130}
            continue
        red, green, blue = ([210, 40, 90][i] for i in range(3))
        grey = 0.299 * red + 0.587 * green + 0.114 * blue
        mixed = [min(255, max(0, r.saturation * c + (1 - r.saturation) * grey)) / 255 for c in (red, green, blue)]
        hue, saturation, value = colorsys.rgb_to_hsv(*mixed)
        want = [c * 255 for c in colorsys.hsv_to_rgb((hue + r.hue) % 1, saturation, value)]
        assert all(abs(r.out[9 * i + j] - want[i]) <= 2.5 for i in range(3) for j in range(9))
