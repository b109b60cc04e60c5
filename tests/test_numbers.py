"""Numbers made from counters: bijections, spread, and samples over many keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import numbers
from framelake.operators import stats


def plain(key, seed):
    high, low = numbers.rounds(key >> 32 & numbers.MASK, key & numbers.MASK, seed, lambda a, b, c, k: a ^ ((b * c + k) >> 15 & numbers.MASK))
    return (high ^ 1 << 31) - (1 << 31) << 32 | low


def test_numbers_are_a_bijection_of_longs(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 2**32, 1000003, *range(5, 2000000003, 1000003)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", numbers.number(F.col("k"), 7).alias("v")).collect()
    assert all(r.v == plain(r.k, 7) for r in rows) and len({r.v for r in rows}) == len(set(keys))
    spread = np.array([r.v for r in rows[7:]], float)
    assert abs(spread.mean()) < 2**63 * 0.05  # keys that are equal modulo 1000003
    n = spark.range(1_000_000).select(numbers.number(F.col("id"), 1).alias("v")).distinct().count()
    assert n == 1_000_000


@pytest.mark.parametrize("stride", [1, 1000003, 1 << 20, 1 << 40])
def test_draws_are_even(spark, stride):
    """By chi square: bytes and percents of keys one and many apart, and pairs of neighbours."""
    keys = spark.range(200_000).select((F.col("id") * stride % (1 << 62)).alias("k"))
    drawn = keys.select(numbers.below(F.col("k"), 256, 3).alias("a"), numbers.below(F.col("k"), 100, 1).alias("b"), (numbers.below(F.col("k"), 16, 3) * 16 + numbers.below(F.col("k") + stride, 16, 3)).alias("c")).toPandas()
    for c, n in (("a", 256), ("b", 100), ("c", 256)):
        seen = np.bincount(drawn[c], minlength=n)
        chi = ((seen - 200_000 / n) ** 2 / (200_000 / n)).sum()
        assert len(seen) == n and chi < n + 6 * np.sqrt(2 * n)


def test_uniform_ranges(spark):
    u = spark.range(50_000).select(numbers.uniform(F.col("id"), 2).alias("u"), numbers.uniform(F.col("id"), 2, True).alias("s")).toPandas()
    assert 0 <= u.u.min() < 0.001 and 0.999 < u.u.max() < 1 and np.allclose(u.s, 2 * u.u - 1)
    assert abs(u.u.mean() - 0.5) < 0.01 and abs(u.u.var() - 1 / 12) < 0.002


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 100, 1601, 50_000])
def test_places_are_permuted(spark, n):
    got = spark.range(n).select(numbers.permuted(F.col("id"), n, 5).alias("v")).toPandas()["v"].to_numpy()
    assert sorted(got) == list(range(n))
    if n > 1000:
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1 and abs(np.corrcoef(got[:-1], got[1:])[0, 1]) < 0.1
        other = spark.range(n).select(numbers.permuted(F.col("id"), n, 6).alias("v")).toPandas()["v"].to_numpy()
        assert (got == other).mean() < 0.01


def test_a_sample_of_very_many_keys_comes_from_all_residues(spark):
    got = [r.id for r in stats.sample_n(spark.range(100_000_000, numPartitions=16), "id", 100, 11).collect()]
    assert len(set(got)) == 100 and len({i % 1000003 for i in got}) == 100
    assert len({i // 10_000_000 for i in got}) == 10


def test_shuffled_batches_hold_all_rows_once(spark):
    got = stats.batches(spark.range(1000).withColumnRenamed("id", "k"), 32, ["k"], 8).groupBy("batch").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).orderBy("batch").collect()
    assert [r.n for r in got] == [32] * 31 + [8] and np.mean([r.b - r.a for r in got]) > 700
