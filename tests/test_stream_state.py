"""State of streams: packets in any order, repeats, lost beats, silent streams, and what is still held in the end."""

import datetime
import random

import pytest

from framelake.streaming import frames as streams

BEATS = "stream string, frame_id long, seq long, last boolean, end boolean, ts timestamp"
START = datetime.datetime(2026, 1, 1)


def run(spark, tmp_path, name, parts, schema, made):
    """(rows, progress) of a stream over the parts, one a trigger; made turns the stream into what is written."""
    for i, part in enumerate(parts):
        rows = [(*r, START + datetime.timedelta(hours=i)) for r in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    out = made(source).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check")
    q = out.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/{name}-out").collect(), q.recentProgress


def held(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def frame(n, k, size=128):
    return [("s", n, i, i % size == size - 1, i == k * size - 1) for i in range(k * size)]


def test_packets_of_shuffled_beats(spark, tmp_path):
    """25,600 beats in any order, in one trigger and in four with repeats, are 200 packets of 128."""
    beats = frame(1, 200)
    random.Random(1).shuffle(beats)
    want = [(i, 128, True) for i in range(200)]
    packets = lambda rows: sorted((r.packet, r.beats, r.complete) for r in rows)
    long = lambda df: streams.stream_packets(df, idle_ms=86_400_000)
    assert packets(run(spark, tmp_path, "one", [beats], BEATS, long)[0]) == want
    assert packets(run(spark, tmp_path, "four", [beats[i::4] + beats[:50] for i in range(4)], BEATS, long)[0]) == want


def test_state_of_frames_ends_and_a_lost_beat_is_told(spark, tmp_path):
    whole = [b for n in range(30) for b in frame(n, 2, 8)]
    lost = [b for b in frame(99, 3, 8) if b[2] != 11]
    clock = lambda n: [("clock", n, 0, True, True)]
    parts = [whole + lost[:10], lost[10:] + whole[:5], clock(1), clock(2)]
    rows, progress = run(spark, tmp_path, "lost", parts, BEATS, lambda df: streams.stream_packets(df, idle_ms=600_000))
    got = sorted((r.frame_id, r.packet, r.beats, r.complete) for r in rows if r.stream == "s")
    assert got == sorted([(n, p, 8, True) for n in range(30) for p in range(2)] + [(99, 0, 8, True), (99, 1, 15, False)])
    assert max(held(progress)) >= 31 and held(progress)[-1] <= 4  # only what the last clock has set


def test_an_early_end_and_a_frame_without_end(spark, tmp_path):
    """The frame's end may come before its other beats; a frame whose end never comes is told too."""
    beats = frame(1, 2, 4)
    parts = [beats[7:] + frame(2, 1, 4)[:3], beats[:7], [("clock", 0, 0, True, True)], [("clock", 1, 0, True, True)]]
    rows, _ = run(spark, tmp_path, "early", parts, BEATS, lambda df: streams.stream_packets(df, idle_ms=4 * 3_600_000 // 3))
    got = sorted((r.frame_id, r.packet, r.beats, r.complete) for r in rows if r.stream == "s")
    assert got == [(1, 0, 4, True), (1, 1, 4, True), (2, 0, 3, False)]


@pytest.mark.parametrize("idle,windows", [(600_000, [(1, 0, 20), (1, 0, 15), (1, 1, 5), (2, 0, 7)]), (86_400_000, [(1, 0, 20), (1, 1, 20)])])
def test_silent_streams_are_forgotten(spark, tmp_path, idle, windows):
    parts = [[(1,)] * 25 + [(2,)] * 7, [(3,)], [(1,)] * 15, [(3,)], [(3,)]]
    rows, progress = run(spark, tmp_path, f"idle{idle}", parts, "stream long, ts timestamp", lambda df: streams.stream_fps_by_count(df, 20, idle_ms=idle))
    assert sorted((r.stream, r.win, r.frames) for r in rows if r.stream < 3) == sorted(windows)
    assert held(progress)[-1] <= (4 if idle < 1e6 else 12)


def test_a_stream_of_a_table_of_one_file_or_many(spark, tmp_path):
    """A table is taken up whole, be it a file or a folder of files."""
    rows = spark.range(30)
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/t.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/t.parquet")
    for path in (f"{tmp_path}/folder/t.parquet", f"{tmp_path}/t.parquet"):
        out = f"{path}-out"
        stream = streams.read_table_stream(spark, path, rows.schema, 2)
        streams.stream_upscale(stream, lambda batch: batch, out, f"{path}-check").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_triggers_take_more_files_of_a_larger_table(spark, tmp_path, monkeypatch):
    from framelake.plans import registry

    monkeypatch.setattr(registry.src, "frame_events", lambda s, d: s.range(0, 400, 1, 12).selectExpr("id as event_id", "id % 3 as stream"))
    monkeypatch.setattr(registry.src, "frame_texts", lambda s, d: s.range(0, 24, 1, 12).selectExpr("id as frame_id", "'s' as stream", "repeat('a', 4096) as text"))
    taken, read = [], streams.read_frame_stream
    monkeypatch.setattr(registry.streams, "read_frame_stream", lambda s, path, schema, files: taken.append(files) or read(s, path, schema, files))
    assert registry.QUERIES["x3_idle_streams"](spark, "").count() == 21
    assert sum(r.beats for r in registry.QUERIES["x5_lost_beats"](spark, "").collect()) == 24 * 256 - 5
    assert taken == [3, 12]
