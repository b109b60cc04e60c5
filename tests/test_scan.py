"""Segmented scans against plain loops and windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import scan, stats


def plain(rows, after):
    """(key, at) -> (segment, place, carried) by a loop over sorted rows."""
    out, before = {}, object()
    for key, at, edge, counts, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if key != before:
            before, segment, place, carried, close = key, 0, 0, None, False
        if (close if after else edge):
            segment, place = segment + 1, 0
            carried = None if after else value
        out[key, at] = (segment, place, carried)
        place += bool(counts)
        close = bool(edge)
    return out


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("seed,keys,edges", [(1, 1, 0.01), (2, 3, 0.3), (3, 400, 0.2), (4, 2, 0.0), (5, 1, 1.0)])
def test_segments_against_a_loop(spark, after, seed, keys, edges):
    """With null keys and flags, keys of one row and keys of several partitions; small Arrow batches."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(keys)]), i, rng.choice([None, rng.random() < edges]), rng.choice([True, False, None]), rng.choice([None, "a", "b"])) for i in range(1200)]
    df = spark.createDataFrame(rows, "key int, i int, e boolean, n boolean, value string").withColumn("segment", F.lit("replaced"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        carry = {} if after else {"carried": F.col("value")}
        got = scan.segmented_scan(df, ["key"], ["i"], F.col("e"), F.col("n"), after, carry).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(rows, after)
    assert len(got) == len(rows)
    assert {(r.key, r.i): (r.segment, r.place, None if after else r.carried) for r in got} == want


def test_segments_of_an_empty_table(spark):
    df = spark.createDataFrame([], "key int, i int, e boolean")
    assert scan.segmented_scan(df, ["key"], ["i"], F.col("e")).count() == 0


def test_one_long_frame_is_many_tasks_and_equals_the_window(spark):
    """One frame of two million beats: no task of the scan sees more than a share of it."""
    n = 2_000_000
    beats = spark.range(n).select(F.lit("s").alias("stream"), F.lit(1).cast("long").alias("frame_id"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(997)) == 0).alias("last"))
    got = stats.assemble_packets(beats, 128)
    parts = scan.segmented_scan(beats, ["stream", "frame_id"], ["seq"], F.col("last"), after=True).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n
    w = Window.partitionBy("stream", "frame_id").orderBy("seq")
    marked = beats.withColumn("b", F.coalesce(F.lag(F.col("last").cast("int")).over(w), F.lit(0))).withColumn("packet", F.sum("b").over(w))
    want = marked.groupBy("stream", "frame_id", "packet").agg(F.count("*").alias("beats"), (F.count("*") == 128).alias("ok"))
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_headers_are_carried_over_partitions(spark):
    lines = [(0, i, "Feature map 7:" if i in (10, 3000) else "" if i % 11 == 5 else str(i)) for i in range(6000)]
    got = {(r.pos, r.v): r.map for r in scan.parse_fmap_log(spark.createDataFrame(lines, "file int, line int, text string")).collect()}
    pos, want = None, {}
    for _, i, text in lines:
        if text.startswith("Feature"):
            pos = 0
        elif text and pos is not None:
            want[pos, float(i)] = 7
            pos += 1
    assert got == want


def test_range_partitions_follow_from_the_rows(spark, monkeypatch):
    """Partitions hold so many rows at most on average, whatever the number of shuffle partitions, and packets are the same."""
    from framelake.operators import scan, stats

    beats = spark.range(4000).selectExpr("'s' as stream", "id div 2000 as frame_id", "id % 2000 as seq", "id % 8 = 7 as last")
    packets = lambda: sorted(map(tuple, stats.assemble_packets(beats, 8).collect()))
    want, tables = packets(), []
    monkeypatch.setattr(scan, "ROWS", 100)
    kept = scan.written
    monkeypatch.setattr(scan, "written", lambda df, name: tables.append(kept(df, name)) or tables[-1])
    assert packets() == want and len(want) == 500
    assert tables[-1].select("part").distinct().count() > 20
