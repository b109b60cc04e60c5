"""Raw frames: round trips, rejects, ranges cut at frame borders, writers that fail, streams that are stopped and go on."""

import os

import pytest
from pyspark.sql import functions as F

from framelake.sources import raw
from framelake.streaming import frames as streams

SIZE = 4 * 4 * 2


def frames(spark, n, names=("a", "b"), first=0):
    data = [(names[i % len(names)], i, bytes([(i + j) % 256 for j in range(SIZE)])) for i in range(first, first + n)]
    return spark.createDataFrame(data, "name string, id long, data binary")


def files_of(path):
    return sorted(os.path.join(top, f) for top, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("task_bytes", [raw.TASK_BYTES, 3 * SIZE, 1])
def test_round_trip_and_ranges(spark, tmp_path, task_bytes):
    path = f"file://{tmp_path}/out"
    made = frames(spark, 101)
    raw.write_frames(made.repartition(3).sortWithinPartitions("name", "id"), path, "yuyv", 4, 4)
    good, rejected = raw.read_frames(spark, path, "yuyv", 4, 4, taskBytes=task_bytes)
    assert good.rdd.getNumPartitions() == -(-101 // max(1, task_bytes // SIZE)) and rejected.count() == 0
    assert sorted(map(tuple, good.select("id", "data").collect())) == sorted(map(tuple, made.select("id", "data").collect()))
    by = good.groupBy("path").agg(F.array_sort(F.collect_list("frame")).alias("frames")).collect()
    assert all(r.frames == list(range(len(r.frames))) for r in by) and len(by) == 6
    assert not any(raw.TEMPORARY in f for f in files_of(tmp_path))


def test_rejects_wrong_sizes_and_hidden_files(spark, tmp_path):
    for name, n in (("a.yuyv", SIZE), ("b.yuyv", SIZE - 1), ("c.yuyv", 0), ("d.yuyv", 3 * SIZE), ("_e.yuyv", SIZE), ("f.txt", SIZE), ("_temporary/g.yuyv", SIZE)):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(bytes(n))
    good, rejected = raw.read_frames(spark, str(tmp_path), "yuyv", 4, 4)
    assert sorted((os.path.basename(r.path), r.frame, r.id) for r in good.collect()) == [("a.yuyv", 0, None), *[("d.yuyv", i, None) for i in range(3)]]
    assert sorted((os.path.basename(r.path), r.length) for r in rejected.collect()) == [("b.yuyv", SIZE - 1), ("c.yuyv", 0)]
    for df in raw.read_frames(spark, f"{tmp_path}/nothing", "yuyv", 4, 4):
        assert df.count() == 0


def test_overwrite_append_and_a_writer_that_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    ids = lambda: sorted(r.id for r in raw.read_frames(spark, path, "yuyv", 4, 4)[0].collect())
    raw.write_frames(frames(spark, 5), path, "yuyv", 4, 4)
    raw.write_frames(frames(spark, 3, first=5), path, "yuyv", 4, 4)
    assert ids() == list(range(8))
    bad = frames(spark, 40, first=100).withColumn("data", F.when(F.col("id") == 139, F.lit(b"short")).otherwise(F.col("data")))
    for wrong in (bad, frames(spark, 4).withColumn("name", F.lit("../up")), frames(spark, 4).withColumn("name", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="has 5 bytes, not 32|can't be the name"):
            raw.write_frames(wrong, path, "yuyv", 4, 4, mode="overwrite")
    assert ids() == list(range(8)) and not any(raw.TEMPORARY in f for f in files_of(tmp_path))  # nothing lost, nothing left
    raw.write_frames(frames(spark, 2, first=50), path, "yuyv", 4, 4, mode="overwrite")
    assert ids() == [50, 51]


def test_a_stream_takes_two_frames_at_a_time_and_goes_on_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        df = raw.stream_frames(spark, source, "yuyv", 4, 4, str(tmp_path / "progress"), 2)
        q = df.select("id", "data").writeStream.foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{out}/epoch={e}")).option("checkpointLocation", str(tmp_path / "check")).start()
        streams.drain(q)

    def taken():
        return [(r.epoch, r.ids) for r in spark.read.parquet(out).groupBy("epoch").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("epoch").collect()]

    raw.write_frames(frames(spark, 7, ("a",)).coalesce(1), source, "yuyv", 4, 4)
    run()
    first = taken()
    assert [len(ids) for _, ids in first] == [2, 2, 2, 1] and sorted(i for _, ids in first for i in ids) == list(range(7))
    raw.write_frames(frames(spark, 4, ("0",), first=7).coalesce(1), source, "yuyv", 4, 4)  # sorts before what was there
    for _ in range(2):  # a restart may repeat its last promise first
        run()
    assert taken()[:4] == first and all(len(ids) <= 2 for _, ids in taken())
    assert sorted(i for _, ids in taken() for i in ids) == list(range(11))


def test_a_promise_that_the_checkpoint_never_saw_is_repeated(tmp_path):
    (tmp_path / "a.yuyv").write_bytes(bytes(9 * SIZE))
    new = lambda: raw.RawStream(raw.Raw(str(tmp_path), "yuyv", 4, 4), str(tmp_path / "progress"), 2, 1 << 20)
    stream = new()
    assert [stream.latestOffset()["frames"] for _ in range(3)] == [2, 2, 2]  # not planned yet: no further promise
    stream.partitions({"frames": 0}, {"frames": 2})
    assert stream.latestOffset() == {"frames": 4}
    again = new()  # stopped before Spark wrote down the 4
    assert again.latestOffset() == {"frames": 4}
    assert [p.ranges for p in again.partitions({"frames": 2}, {"frames": 4})] == [[(str(tmp_path / "a.yuyv"), 2, 2)]]
    assert again.latestOffset() == {"frames": 6}
    replay = new()
    assert [p.ranges for p in replay.partitions({"frames": 0}, {"frames": 2})] == [[(str(tmp_path / "a.yuyv"), 0, 2)]]  # a batch that had been planned before


def test_the_folder_is_listed_only_when_a_trigger_has_room(tmp_path):
    (tmp_path / "a.yuyv").write_bytes(bytes(8 * 10))
    stream = raw.RawStream(raw.Raw(str(tmp_path), "yuyv", 2, 2), str(tmp_path / "_progress"), 2, 1 << 20)
    listed, files = [], raw.Raw.files
    ends = []
    try:
        raw.Raw.files = lambda self: listed.append(1) or files(self)
        for _ in range(6):
            end = stream.latestOffset()
            stream.partitions({"frames": stream.base}, end)
            ends.append(end["frames"])
    finally:
        raw.Raw.files = files
    assert ends == [2, 4, 6, 8, 10, 10] and len(listed) == 2


def test_sums_of_a_stream_that_fails_and_goes_on(spark, tmp_path):
    """Each frame is in one trigger's sums, of at most two frames, though a trigger fails and is run again; other streams keep their logs' writer."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw.write_frames(frames(spark, 7, ("a",)).coalesce(1), source, "yuyv", 4, 4)

    def run(fails=()):
        seen = []

        def sums(batch):
            table = streams.counted(batch)
            seen.append(table["n"].to_pylist())
            if len(seen) in fails:
                raise ValueError("in the middle")
            return table

        df = raw.stream_frames(spark, source, "yuyv", 4, 4, str(tmp_path / "progress"), 2, taskBytes=SIZE)  # two tasks a trigger
        streams.drain(streams.stream_sums(df, sums, out, str(tmp_path / "check")))
        return seen

    with pytest.raises(Exception, match="in the middle"):
        run(fails=(3,))
    assert run() == [[2], [1]]
    assert sorted((r.epoch, r.n) for r in spark.read.parquet(out).collect()) == [(0, 2), (1, 2), (2, 2), (3, 1)]
    assert spark.conf.get(streams._LOGS, None) is None and files_of(out) == [f"{out}/{i}.parquet" for i in range(4)]


def texts(spark, path, n):
    rows = [(i, "ab"[i % 2], chr(97 + i % 26) * 2048 + "".join(chr(33 + (i * j) % 200) for j in range(2048 + i))) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def stages_by_job(spark, monkeypatch, query, path):
    """The query's rows, and the numbers of stages of the jobs that its stream's triggers ran."""
    from framelake.plans import registry

    tracker, runs, drain = spark.sparkContext.statusTracker(), [], streams.drain
    monkeypatch.setattr(registry.streams, "drain", lambda q: runs.append(str(q.runId)) or drain(q))
    rows = [r.asDict() for r in registry.QUERIES[query](spark, path).collect()]
    return rows, [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(runs[0])]


def test_a_trigger_that_counts_frames_in_flight_is_one_job_of_one_stage(spark, tmp_path, monkeypatch):
    rows, stages = stages_by_job(spark, monkeypatch, "x2_frames_in_flight", texts(spark, tmp_path, 300))
    assert rows == [{"epochs": 3, "n_tiles": 600, "most": 250}] and stages == [1, 1, 1]


def test_no_frames_in_flight(spark, tmp_path):
    from framelake.plans import registry

    path = texts(spark, tmp_path, 300)
    spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 0").write.parquet(f"{path}/none/documents.parquet")
    assert [tuple(r) for r in registry.QUERIES["x2_frames_in_flight"](spark, f"{path}/none").collect()] == [(0, 0, 0)]


def test_a_trigger_that_routes_raw_frames_is_one_job_of_one_stage(spark, tmp_path, monkeypatch):
    from framelake.operators import stats
    from framelake.sources import frames as src

    path = texts(spark, tmp_path, 600)
    rows, stages = stages_by_job(spark, monkeypatch, "x1_stream_raw", path)
    twin = stats.route_summary(stats.route_tiles(src.raw_tiles(spark, path)), ["stream"]).select("stream", "n_tiles", "n_cnn", "n_interp")
    by = lambda r: r["stream"]
    assert sorted(rows, key=by) == sorted((r.asDict() for r in twin.collect()), key=by) and sum(r["n_tiles"] for r in rows) == 1200
    assert all(r["n_cnn"] and r["n_interp"] for r in rows) and stages == [1, 1]
