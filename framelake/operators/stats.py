"""Aggregates and windows over tiles, errors, metrics and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..sources.frames import numbered
from . import pca
from .scan import segmented_scan


def luma_variance(data: str = "data", n: int = 1024) -> dict[str, Column]:
    """sum_y, mean_y and var_num of a YUYV tile's bytes: the sum of squares about the integer mean, in one pass over the array."""
    sums = F.expr(f"aggregate(sequence(0, {n - 1}), struct(0L as s, 0L as q), (a, i) -> struct(a.s + {data}[2 * i] as s, a.q + {data}[2 * i] * {data}[2 * i] as q))")
    return {"_sums": sums, "sum_y": F.col("_sums.s"), "mean_y": F.expr(f"_sums.s div {n}"), "var_num": F.expr(f"_sums.q - 2 * (_sums.s div {n}) * _sums.s + {n} * (_sums.s div {n}) * (_sums.s div {n})")}


def tile_variance(tiles: DataFrame, n: int = 1024, wrap: bool = False) -> DataFrame:
    """tiles (data) with sum_y, mean_y, var_num and variance; wrap keeps var_num in 32 bits with 8 of fraction, as a 24-bit integer."""
    cols = luma_variance(n=n)
    out = tiles.withColumn("_sums", cols.pop("_sums")).withColumns(cols).drop("_sums")
    if wrap:
        out = out.withColumn("var_num", F.pmod(F.col("var_num") + (1 << 23), F.lit(1 << 24)) - (1 << 23))
    return out.withColumn("variance", F.col("var_num") / float(n))


def pixel_variance(pixels: DataFrame, keys: list[str], kind: str = "rgb_pop") -> DataFrame:
    """Variance by group over the three channels (population or sample), or of gray."""
    if kind == "gray":
        return pixels.groupBy(*keys).agg(F.round(F.var_pop("gray"), 6).alias("variance"))
    n, s, q = F.count("*") * 3, F.sum(F.expr("r + g + b")), F.sum(F.expr("r * r + g * g + b * b"))
    top = n * q - s * s
    return pixels.groupBy(*keys).agg(F.round(top / (n * (n if kind == "rgb_pop" else n - 1)), 6).alias("variance"))


def route_tiles(tiles: DataFrame, threshold: float = 1000, override: int = 0, op: str = ">", wrap: bool = False) -> DataFrame:
    """tiles with route: 'cnn' above the threshold, else 'interp'; override 1 and 2 send all one way and need no variance."""
    if override:
        return tiles.withColumn("route", F.lit("cnn" if override == 1 else "interp"))
    scored = tile_variance(tiles, wrap=wrap)
    above = F.col("variance") > threshold if op == ">" else F.col("variance") >= threshold
    return scored.withColumn("route", F.when(above, "cnn").otherwise("interp"))


def route_summary(tiles: DataFrame, keys: list[str]) -> DataFrame:
    cnn = F.count_if(F.col("route") == "cnn")
    return tiles.groupBy(*keys).agg(F.count("*").alias("n_tiles"), cnn.alias("n_cnn"), (F.count("*") - cnn).alias("n_interp"))


def tile_report(tiles: DataFrame, threshold: float = 1000, size: int = 32) -> DataFrame:
    """A line for each tile (frames one tile wide have no tile_x), with its place and the name its crop would have; halves in the name's figure go to the even digit."""
    x = F.col("tile_x") if "tile_x" in tiles.columns else F.lit(0)
    name = F.format_string("crop_%d_%d_%s_var%.2f", "tile_y", x, "route", F.bround("variance", 2))
    place = [(F.col("tile_y") * size).alias("src_y"), (x * size).cast("int").alias("src_x"), F.lit(size).alias("size")]
    return tiles.select("frame_id", "tile_y", x.cast("int").alias("tile_x"), *place, "route", "variance", F.lit(float(threshold)).alias("threshold"), name.alias("name"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """(bin, lo, n) of equal widths between least and largest; the last bin is closed, empty bins count 0."""
    ends = df.agg(F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("b"))
    place = F.least(F.lit(bins - 1), F.when(F.col("b") > F.col("a"), F.floor((F.col(col) - F.col("a")) / ((F.col("b") - F.col("a")) / bins))).otherwise(0)).cast("int")
    counts = df.where(F.col(col).isNotNull()).join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.round(F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins, 6).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def error_stats(pairs: DataFrame, keys: list[str], outlier: float = 20) -> DataFrame:
    """Total, mean and worst absolute error of expected and actual, and the mean percent error without outliers."""
    d, p = F.abs(F.col("expected") - F.col("actual")), F.when(F.col("expected") != 0, F.abs(F.col("expected") - F.col("actual")) * 100 / F.abs("expected"))
    return pairs.groupBy(*keys).agg(F.sum(d).alias("total"), F.round(F.avg(d), 6).alias("mean"), F.max(d).alias("worst"), F.round(F.avg(F.when(p <= outlier, p)), 6).alias("percent"))


def psnr(pairs: DataFrame, image: str, peak: float = 255) -> DataFrame:
    """(image, mse, psnr): psnr is null where images are equal."""
    mse = F.sum((F.col("expected") - F.col("actual")) * (F.col("expected") - F.col("actual"))) / F.count("*") / (peak * peak)
    by = pairs.groupBy(image).agg(mse.alias("m"))
    return by.select(image, F.round("m", 9).alias("mse"), F.round(F.when(F.col("m") > 0, 10 * F.log10(1 / F.col("m"))), 6).alias("psnr"))


def mean_psnr(by_image: DataFrame) -> DataFrame:
    """(images, equal, mse, psnr) from psnr(): averages over images; those that are equal have no psnr and don't count in its average."""
    equal = F.count_if(F.col("psnr").isNull())
    return by_image.agg(F.count("*").alias("images"), equal.alias("equal"), F.round(F.avg("mse"), 8).alias("mse"), F.round(F.avg("psnr"), 5).alias("psnr"))


def loss_rollup(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per epoch: the sum of batch means over samples, and over batches."""
    return metrics.groupBy(*keys).agg(F.round(F.sum("batch_mean") / F.sum("n"), 9).alias("per_sample"), F.round(F.avg("batch_mean"), 6).alias("per_batch"))


def weight_extremes(weights: DataFrame) -> DataFrame:
    """Least and largest weight with their layers; of equals the first layer."""
    return weights.agg(F.min("w").alias("w_min"), F.min_by("layer", F.struct("w", "layer")).alias("layer_min"), F.max("w").alias("w_max"), F.max_by("layer", F.struct(F.col("w"), -F.col("layer"))).alias("layer_max"))


def threshold_sweep(tiles: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, n_tiles, n_cnn, share) in one pass: each tile counts for all thresholds at once."""
    aggs = [F.count_if(F.col("variance") > t).alias(f"t{t}") for t in thresholds]
    sums = tiles.agg(F.count("*").alias("n_tiles"), *aggs)
    rows = sums.select("n_tiles", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_cnn")) for t in thresholds])))
    return rows.select("threshold", "n_tiles", "n_cnn", F.round(F.col("n_cnn") / F.col("n_tiles"), 9).alias("share"))


def curate_pairs(pairs: DataFrame, least: float, least_low: float | None = None) -> DataFrame:
    """Pairs with enough detail on both sides; the low side may have its own least variance."""
    return pairs.where((F.col("hi_variance") >= least) & (F.col("lo_variance") >= (least if least_low is None else least_low)))


def tile_pca(tiles: DataFrame, array: str, k: int = 2) -> DataFrame:
    """tiles with pc: coordinates on the first k principal components of an array column."""
    mean, axes, _, _ = pca.principal(tiles, array, k)
    return pca.project(tiles, array, "pc", mean, axes)


# --- windows -----------------------------------------------------------------------------------


def place_within(df: DataFrame, key: str, order: list[str], name: str, **sums: Column) -> DataFrame:
    """df with each row's place (from 0) among the rows of its key, and aggregates over these rows.

    Rows are numbered over all keys at once, and a key's first place is taken off, so that no task has
    to hold or sort all rows of one key.
    """
    placed = numbered(df, [key, *order], "_pos")
    of = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_pos").alias("_first"), *[e.alias(c) for c, e in sums.items()])
    joined = placed.join(of, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(*df.columns, (F.col("_pos") - F.col("_first")).alias(name), *sums)


def progress(df: DataFrame, run: str, order: list[str], ts: str) -> DataFrame:
    """done, total, percent, elapsed and remaining seconds and rows a second at each row of a run; no rate before any time has passed."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = place_within(df, run, order, "done", total=F.count("*"), _began=F.min(micros)).withColumns({"done": F.col("done") + 1, "elapsed": (micros - F.col("_began")) / 1e6}).drop("_began")
    out = placed.withColumn("rate", F.when(F.col("elapsed") > 0, F.round(F.col("done") / F.col("elapsed"), 6)))
    return out.withColumns({"percent": F.round(100.0 * F.col("done") / F.col("total"), 6), "remaining": F.round(F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")), 6), "elapsed": F.round("elapsed", 6)})


def fps_by_count(df: DataFrame, stream: str, order: list[str], ts: str, n: int = 99) -> DataFrame:
    """(stream, win, frames, seconds) of windows of n frames."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    placed = place_within(df.select(stream, ts, *[c for c in order if c not in (stream, ts)]), stream, order, "_at").withColumn("win", F.floor(F.col("_at") / n))
    return placed.groupBy(stream, "win").agg(F.count("*").alias("frames"), F.round((F.max(micros) - F.min(micros)) / 1e6, 6).alias("seconds"))


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, found with partial aggregation."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("s")).select(key, "s.*")


def assemble_packets(beats: DataFrame, expected: int, keys: tuple[str, ...] = ("stream", "frame_id"), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(keys, packet, beats, ok): a packet ends with a beat marked last, what comes after the last of these is a packet too.

    The open packet is carried from range partition to range partition, so one key may have any number of beats.
    """
    packets = segmented_scan(beats.select(*keys, *order, "last"), list(keys), list(order), F.col("last"), after=True)
    by = packets.groupBy(*keys, F.col("segment").alias("packet"))
    return by.agg(F.count("*").alias("beats"), (F.count("*") == expected).alias("ok"))


# --- sorts, samples, splits --------------------------------------------------------------------


def natural_key(col: str) -> Column:
    """Sorts names by their runs of digits as numbers, of any length, and by what stands between them."""
    parts = F.regexp_extract_all(col, F.lit(r"(\d+|\D+)"), 1)
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    is_number = lambda x: x.rlike(r"^\d")
    return F.transform(parts, lambda x: F.struct((~is_number(x)).alias("text"), F.when(is_number(x), F.length(number(x))).otherwise(0).alias("digits"), F.when(is_number(x), number(x)).otherwise(x).alias("part")))


def natural_rank(df: DataFrame, col: str) -> DataFrame:
    """df with rank: names in natural order, those that differ by leading zeros only as they are."""
    return numbered(df, [natural_key(col), F.col(col)], "rank")


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows chosen by their keys' numbers; different keys have different ones, so no key stands in for another at any number of rows."""
    return df.orderBy(numbers.number(F.col(key), seed), key).limit(n)


def split(df: DataFrame, key: str, seed: int = 1, fractions: tuple[int, ...] = (85, 10, 5), names: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """df with split by a number of the key; fractions in percent."""
    rows, edge, out = df.withColumn("_h", numbers.below(F.col(key), 100, seed)), 0, None
    for share, name in zip(fractions, names, strict=True):
        edge += share
        out = F.when(F.col("_h") < edge, name) if out is None else out.when(F.col("_h") < edge, name)
    return rows.withColumn("split", out).drop("_h")


def batches(df: DataFrame, size: int, order: list[str], seed: int | None = None) -> DataFrame:
    """df with batch: runs of `size` rows in order, or with a seed of rows as if shuffled.

    Shuffled, a row's place goes to another one by a permutation of the places, row by row: rows are not sorted again.
    """
    placed = numbered(df, order, "_pos")
    place = F.col("_pos") if seed is None else numbers.permuted(F.col("_pos"), placed.count(), seed)
    return placed.withColumn("batch", F.floor(place / size)).drop("_pos")


#: What a stimulus is drawn from, as (key, seed) to a column.
RANGES = {"byte": lambda k, s: numbers.below(k, 256, s).cast("int"), "unit": numbers.uniform, "signed": lambda k, s: numbers.uniform(k, s, True)}


def stimulus(keys: DataFrame, key: str, n: int, seed: int = 3, kind: str = "byte") -> DataFrame:
    """n values for each key, as if drawn at random, and alike in each run: bytes, or doubles from [0, 1) ('unit') or [-1, 1) ('signed')."""
    i = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return i.withColumn("v", RANGES[kind](F.col(key) * n + F.col("i"), seed))


def scoreboard(expected: DataFrame, actual: DataFrame, trial: str, place: list[str], tol: int) -> DataFrame:
    """(trial, n_expected, n_actual, n_wrong, passed): an element without partner on either side is wrong, so outputs of another size can't pass."""
    e, a = expected.withColumnRenamed("v", "expected"), actual.withColumnRenamed("v", "actual")
    good = F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tol, F.lit(False))
    sizes = [F.count("expected").alias("n_expected"), F.count("actual").alias("n_actual")]
    return e.join(a, [trial, *place], "full_outer").groupBy(trial).agg(*sizes, F.count_if(~good).alias("n_wrong"), F.bool_and(good).alias("passed"))


def scoreboard_of(pairs: DataFrame, trial: str, tol: int) -> DataFrame:
    """As scoreboard() of expected and actual values that stand side by side."""
    good = F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tol, F.lit(False))
    return pairs.groupBy(trial).agg(F.count("*").alias("n"), F.count_if(~good).alias("n_wrong"), F.bool_and(good).alias("passed"))


def mismatches(pairs: DataFrame, tol: int) -> DataFrame:
    """The pairs that are further apart than tol or lack a side."""
    return pairs.where(~F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tol, F.lit(False)))


def tolerance_sweep(errors: DataFrame, trial: str, error: str, tols: list[int]) -> DataFrame:
    """(tol, n_trials, n_passed) from each trial's worst error."""
    worst = errors.groupBy(trial).agg(F.max(error).alias("worst"))
    sums = worst.agg(F.count("*").alias("n_trials"), *[F.count_if(F.col("worst") <= t).alias(f"t{t}") for t in tols])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("tol"), F.col("n_trials"), F.col(f"t{t}").alias("n_passed")) for t in tols])))
