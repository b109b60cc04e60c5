"""Streams of frames, events and beats, each with a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..operators.stats import route_summary, route_tiles
from ..sources.raw import open_store


def read_frame_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 2, fmt: str = "parquet", pattern: str | None = None) -> DataFrame:
    """A stream of a folder's files, so many a trigger at most."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def read_table_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 2) -> DataFrame:
    """A stream of a table's files, whether the table is one file or a folder of files."""
    return read_frame_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, max_files)  # a stream takes a plain path for a folder, a pattern for either


def stream_upscale(tiles: DataFrame, upscale: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Appends upscale(tiles of a trigger) to the table out, with the trigger's number as epoch; ends with what is there, or if not `once` when it is stopped.

    A trigger that is run again after a failure writes its own folder again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        upscale(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_LOGS, _PLANS = "spark.sql.streaming.checkpointFileManagerClass", "spark.sql.ui.explainMode"
_RENAMED = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"


def stream_sums(frames: DataFrame, sums: Callable[[DataFrame], pa.Table], out: str, checkpoint: str) -> StreamingQuery:
    """Keeps sums(frames of a trigger), a few rows, with the trigger's number as epoch, in the table out, until it is stopped.

    For small triggers, which cost more than their frames do: sums reach the table by the driver, as one
    file that takes its name when it is whole. A trigger that is run again writes its file again.
    Where the checkpoint is on a local disk its logs are written through Hadoop's FileSystem, as Spark
    does for stores without FileContext, which would start a process for each look at a local file.
    Spark's UI shows the triggers' plans in short.
    """
    spark, (store, root) = frames.sparkSession, open_store(out)
    store.create_dir(root)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = sums(batch)
        with store.open_output_stream(f"{root}/.{epoch}") as f:
            pq.write_table(rows.append_column("epoch", pa.array([epoch] * len(rows), pa.int64())), f)
        store.move(f"{root}/.{epoch}", f"{root}/{epoch}.parquet")

    local = "://" not in checkpoint or checkpoint.startswith("file:")
    settings = {_PLANS: "simple"} | ({_LOGS: _RENAMED} if local and not spark.conf.get(_LOGS, None) else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    finally:  # the stream keeps what it was started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counted(batch: DataFrame) -> pa.Table:
    """The number of a trigger's rows (n), counted where they are as they pass."""
    seen = Observation()
    batch.observe(seen, F.expr("count(1) as n")).write.format("noop").mode("overwrite").save()
    return pa.table({"n": pa.array([seen.get["n"]], pa.int64())})


def drain(query: StreamingQuery) -> None:
    """Waits until a stream has taken up all that is there, and stops it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def stream_route(tiles: DataFrame, control: Callable[[], DataFrame], out: str, checkpoint: str):
    """Summaries of each trigger's tiles in the table out, with threshold and override read again from a control table for each trigger."""

    def write(batch: DataFrame, epoch: int) -> None:
        now = control().orderBy(F.desc("since")).first()
        summary = route_summary(route_tiles(batch, now.threshold, now.override), ["stream"])
        summary.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_fps_by_time(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(stream, win_start, frames) of tumbling windows; the watermark bounds what is kept."""
    timed = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "stream").agg(F.count("*").alias("frames"))
    return timed.select("stream", F.col("window.start").alias("win_start"), "frames")


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """rows with a watermark and their time in milliseconds. Timers need the state store that keeps state on disk, for this session's streams from now on."""
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows.withColumn("ms", F.unix_millis(time)).withWatermark(time, delay)


class _Timed(StatefulProcessor):
    """State of a key that a timer ends: it goes off when the watermark has passed the key's latest row by `idle` milliseconds."""

    fields: str

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("open", self.fields)

    def put_off(self, old: int, ms: int) -> int:
        """The time at which the timer goes off now."""
        due = max(old, ms + self.idle)
        if due > old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        return due

    def close(self) -> None:
        pass


class _FpsByCount(_Timed):
    fields = "win long, seen long, timer long"

    def __init__(self, n: int, idle: int) -> None:
        super().__init__(idle)
        self.n = n

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        win, seen, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        if 0 < timer <= timerValues.getCurrentWatermarkInMs():  # it has come back before its timer's turn in this trigger
            yield from self.forget(key)
            win, seen = 0, 0
        came = [(len(r), int(r["ms"].max())) for r in rows]
        full, seen = divmod(seen + sum(n for n, _ in came), self.n)
        self.state.update((win + full, seen, self.put_off(timer, max(ms for _, ms in came))))
        yield pd.DataFrame({"stream": [key[0]] * full, "win": range(win, win + full), "frames": [self.n] * full})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.forget(key)

    def forget(self, key: tuple) -> Iterator[pd.DataFrame]:
        win, seen, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"stream": [key[0]] * bool(seen), "win": [win] * bool(seen), "frames": [seen] * bool(seen)})


def stream_fps_by_count(events: DataFrame, n: int = 99, time: str = "ts", delay: str = "1 minute", idle_ms: int = 3_600_000) -> DataFrame:
    """(stream, win, frames) of windows of n frames in order of arrival.

    A stream's state is its open window's count. A stream that has been silent for idle_ms, by the
    watermark, gives what its open window holds and is forgotten; if it comes back it starts at window 0.
    """
    rows = _timed(events.select("stream", time), time, delay)
    return rows.groupBy("stream").transformWithStateInPandas(_FpsByCount(n, idle_ms), "stream long, win long, frames long", "Append", "EventTime")


class _Packets(_Timed):
    fields = "packet long, held long, due long, end long, timer long, early array<long>, lasts array<boolean>"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        packet, held, due, end, timer, early, lasts = self.state.get() if self.state.exists() else (0, 0, 0, -1, 0, [], [])
        came = [r[["seq", "last", "end", "ms"]] for r in rows]
        seq, last, ends, ms = (np.concatenate([r[c].to_numpy() for r in came]) for c in ("seq", "last", "end", "ms"))
        timer = self.put_off(timer, int(ms.max()))
        end = max(end, int(seq[ends == True].max(initial=-1)))  # noqa: E712  null is no end
        seq, last = np.concatenate([np.array(early, np.int64), seq.astype(np.int64)]), np.concatenate([np.array(lasts, bool), last.astype(bool)])
        seq, at = np.unique(seq, return_index=True)  # of repeats the first
        seq, last = seq[seq >= due], last[at][seq >= due]
        n = int((seq == due + np.arange(len(seq))).sum())  # those whose turn has come: ascending numbers, so all before the first gap
        at = np.flatnonzero(last[:n])
        sizes = np.diff(at, prepend=-1 - held)
        due, held = due + n, held + n if not len(at) else n - 1 - int(at[-1])
        # A frame that has ended keeps no beats, only that it has ended, until its timer goes off: repeats still come.
        self.state.update((packet + len(at), held, due, end, timer, [] if due == end + 1 else seq[n:].tolist(), [] if due == end + 1 else last[n:].tolist()))
        yield self.rows(key, packet + np.arange(len(at)), sizes, True)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        packet, held, due, end, _, early, _ = self.state.get()
        self.state.clear()
        ended = end >= 0 and due == end + 1 and not held
        yield self.rows(key, [] if ended else [packet], [] if ended else [held + len(early)], False)

    @staticmethod
    def rows(key: tuple, packet: Sequence[int], beats: Sequence[int], complete: bool) -> pd.DataFrame:
        stream = pd.Series([key[0]] * len(packet), dtype=object)  # a column of pandas' strings can't be handed back in several pieces
        return pd.DataFrame({"stream": stream, "frame_id": [key[1]] * len(packet), "packet": packet, "beats": beats, "complete": [complete] * len(packet)})


def stream_packets(beats: DataFrame, time: str = "ts", delay: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """(stream, frame_id, packet, beats, complete) of packets that have ended; a frame's beats are numbered by seq from 0 without gaps.

    beats are (stream, frame_id, seq, last, end, time): last marks a packet's last beat, end the frame's.
    They may come in any order, within a trigger and across triggers, and more than once. State is the
    number of the open packet, its beats so far, the next beat's number, and the beats that came before
    their turn.

    A frame's state ends when the watermark has passed its latest beat by idle_ms. If by then the frame
    hasn't ended, its open packet is given as not complete, with the number of beats that came for it and
    after it: somewhere a beat is missing.
    """
    rows = _timed(beats.select("stream", "frame_id", "seq", "last", "end", time), time, delay)
    schema = "stream string, frame_id long, packet long, beats long, complete boolean"
    return rows.groupBy("stream", "frame_id").transformWithStateInPandas(_Packets(idle_ms), schema, "Append", "EventTime")
