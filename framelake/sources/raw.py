"""Raw frame buffers as a data source of Spark: files of frames of one geometry, one after the other, without headers.

Reading cuts files into ranges of bytes at frame borders, so a long file is many tasks and many short
ones are one. Writing puts frames into files by name, first under names that no reader sees, and moves
them when all tasks have succeeded. The streaming source admits so many frames at a time.

Files are reached through pyarrow's file systems, by path or by URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, IntegerType, StructType

BYTES_PER_PIXEL = {"yuyv": 2, "rgb888": 3, "rgb565": 2}
#: A reading task has so many bytes of frames; so many are handed over at once.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
IDS, TEMPORARY = ".ids", "_temporary"

_FRAMES = "path string, frame long, id long, data binary"
_REJECTS = "path string, length long, reason string"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Raw:
    """Where frames are and how large each is."""

    path: str
    fmt: str
    width: int
    height: int

    @property
    def size(self) -> int:
        return self.width * self.height * BYTES_PER_PIXEL[self.fmt]

    def files(self) -> tuple[list[tuple[str, int]], list[tuple[str, int, str]]]:
        """((path, frames) of the good, (path, length, reason) of the others), by path: good ones hold whole frames and at least one."""
        store, root = open_store(self.path)
        seen = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda f: any(x.startswith(("_", ".")) for x in f.path[len(root) :].strip("/").split("/"))
        found = sorted((f.path, f.size) for f in seen if f.is_file and not hidden(f) and f.path.endswith("." + self.fmt))
        good = [(p, n // self.size) for p, n in found if n and n % self.size == 0]
        return good, [(p, n, f"no whole number of frames of {self.size} bytes") for p, n in found if not n or n % self.size]

    def read(self, ranges: Sequence[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        """Rows of ranges (path, first frame, frames), a few megabytes at a time; id is what the writer was given, else null."""
        store, _ = open_store(self.path)
        at_once = max(1, BATCH_BYTES // self.size)
        for path, first, count in ranges:
            named = store.get_file_info(path + IDS).is_file
            with store.open_input_file(path) as f:
                for at in range(first, first + count, at_once):
                    n = min(at_once, first + count - at)
                    data = f.read_at(n * self.size, at * self.size)
                    if len(data) != n * self.size:
                        raise OSError(f"{path} ends within frame {at + len(data) // self.size}")
                    offsets = np.arange(n + 1, dtype=np.int32) * self.size
                    frames = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    ids = pa.nulls(n, pa.int64())
                    if named:
                        with store.open_input_file(path + IDS) as g:
                            ids = pa.array(np.frombuffer(g.read_at(n * 8, at * 8), "<i8"))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), ids, frames], names=["path", "frame", "id", "data"])


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


def cut_ranges(ranges: list[tuple[str, int, int]], frames: int) -> list[Ranges]:
    """Ranges (path, first, count) dealt to tasks of so many frames: long ones are cut, short ones put together."""
    out: list[Ranges] = []
    held: list[tuple[str, int, int]] = []
    room = frames
    for path, first, count in ranges:
        while count:
            n = min(room, count)
            held.append((path, first, n))
            first, count, room = first + n, count - n, room - n
            if not room:
                out.append(Ranges(held))
                held, room = [], frames
    return [*out, Ranges(held)] if held else out


class RawReader(DataSourceReader):
    def __init__(self, raw: Raw, rejects: bool, task_bytes: int) -> None:
        self.raw, self.rejects, self.task_bytes = raw, rejects, task_bytes

    def partitions(self) -> Sequence[InputPartition]:
        if self.rejects:
            return [InputPartition(None)]
        good, _ = self.raw.files()
        return cut_ranges([(p, 0, n) for p, n in good], max(1, self.task_bytes // self.raw.size)) or [Ranges([])]

    def read(self, partition: InputPartition) -> Iterator:
        return iter(self.raw.files()[1]) if self.rejects else self.raw.read(partition.ranges)


@dataclass
class Written(WriterCommitMessage):
    #: (temporary, final) paths, in the order in which they are moved.
    moves: list[tuple[str, str]] = field(default_factory=list)


class RawWriter(DataSourceArrowWriter):
    """Frames (name, id, data) to files <name>-<task>-<run>.<fmt>, a file for each run of a name in a task; ids go to a file beside it.

    With `ragged` data may have any length, and files need not hold whole frames.
    """

    def __init__(self, raw: Raw, ragged: bool, overwrite: bool) -> None:
        self.raw, self.ragged, self.overwrite, self.job = raw, ragged, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.raw.path)
        task = TaskContext.get()
        folder = f"{root}/{TEMPORARY}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder)
        out, name, files = Written(), None, []
        for batch in iterator:
            for one, id_, data in zip(batch.column("name").to_pylist(), batch.column("id").to_pylist(), batch.column("data"), strict=True):
                if one is None or "/" in one or one.startswith(("_", ".")):
                    raise ValueError(f"{one!r} can't be the name of a file of frames")
                if one != name:
                    for f in files:
                        f.close()
                    name, at = one, f"{one}-{task.partitionId():05d}-{len(out.moves)}-{self.job[:8]}.{self.raw.fmt}"
                    files = [store.open_output_stream(f"{folder}/{at}"), store.open_output_stream(f"{folder}/{at}{IDS}")]
                    out.moves += [(f"{folder}/{at}{IDS}", f"{root}/{at}{IDS}"), (f"{folder}/{at}", f"{root}/{at}")]
                buffer = data.as_buffer()
                if buffer is None or not self.ragged and buffer.size != self.raw.size:
                    raise ValueError(f"frame {id_} of {name} has {buffer and buffer.size} bytes, not {self.raw.size}")
                files[0].write(buffer)
                files[1].write(int(-1 if id_ is None else id_).to_bytes(8, "little", signed=True))
        for f in files:
            f.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.raw.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            for temporary, final in m.moves if m else ():
                store.move(temporary, final)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_store(self.raw.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Takes away what this job's tasks have left, lost attempts included."""
        if store.get_file_info(f"{root}/{TEMPORARY}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{TEMPORARY}/{self.job}")


class RawStream(DataSourceStreamReader):
    """Frames of the folder's files in the order in which these were found, so many a trigger.

    An offset is a number of frames. Which files they are in is written to the folder `progress`
    before they are promised to Spark, and so is each promise. After a restart the last promise is
    repeated: Spark's checkpoint either knows it, or takes it up now. Files must not change once seen.
    """

    def __init__(self, raw: Raw, progress: str, frames: int, task_bytes: int) -> None:
        self.raw, self.progress, self.frames, self.task_bytes = raw, progress, frames, task_bytes
        self.base: int | None = None  # the end of what Spark has planned
        self.log: list[tuple[str, int]] = []

    def _load(self, name: str) -> list | None:
        store, root = open_store(self.progress)
        if not store.get_file_info(f"{root}/{name}").is_file:
            return None
        with store.open_input_file(f"{root}/{name}") as f:
            return json.loads(f.read())

    def _save(self, name: str, value: list) -> None:
        store, root = open_store(self.progress)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/.{name}") as f:
            f.write(json.dumps(value).encode())
        store.move(f"{root}/.{name}", f"{root}/{name}")

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        if self.base is None:  # just started
            self.log = [tuple(x) for x in self._load("files") or []]
            if promised := (self._load("promised") or [0])[0]:
                self.base = promised
                return {"frames": promised}
            self.base = 0
        if sum(n for _, n in self.log) - self.base < self.frames:  # else the next trigger is full, and the folder need not be listed for it
            known = {p for p, _ in self.log}
            if new := [x for x in self.raw.files()[0] if x[0] not in known]:
                self.log += new
                self._save("files", self.log)
        end = min(sum(n for _, n in self.log), self.base + self.frames)
        if end > self.base:
            self._save("promised", [end])
        return {"frames": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if not self.log:
            self.log = [tuple(x) for x in self._load("files") or []]
        self.base = max(self.base or 0, end["frames"])
        ranges, at = [], 0
        for path, n in self.log:
            a, b = max(start["frames"], at), min(end["frames"], at + n)
            if a < b:
                ranges.append((path, a - at, b - a))
            at += n
        return cut_ranges(ranges, max(1, self.task_bytes // self.raw.size))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.raw.read(partition.ranges)


class RawFrames(DataSource):
    """Format `rawframes` with options path, fmt, width and height.

    Reading gives (path, frame, id, data), or with rejects=true (path, length, reason) of the files that
    don't hold whole frames. Writing takes (name, id, data); ragged=true takes data of any length. A
    stream needs progress, a folder of its own, and maxFrames (2).
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def _raw(self) -> Raw:
        return Raw(self.options["path"], self.options.get("fmt", "yuyv"), int(self.options["width"]), int(self.options["height"]))

    def _on(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def _task_bytes(self) -> int:
        return int(self.options.get("taskBytes", TASK_BYTES))

    def schema(self) -> str:
        return _REJECTS if self._on("rejects") else _FRAMES

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(self._raw(), self._on("rejects"), self._task_bytes())

    def writer(self, schema: StructType, overwrite: bool) -> RawWriter:
        return RawWriter(self._raw(), self._on("ragged"), overwrite)

    def streamReader(self, schema: StructType) -> RawStream:
        return RawStream(self._raw(), self.options["progress"], int(self.options.get("maxFrames", 2)), self._task_bytes())


# --- as functions ------------------------------------------------------------------------------


def read_frames(spark: SparkSession, path: str, fmt: str, width: int, height: int, **options: object) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): the frames of raw files under path, and the files that don't hold whole frames."""
    spark.dataSource.register(RawFrames)
    reader = spark.read.format("rawframes").options(path=path, fmt=fmt, width=width, height=height, **options)
    return reader.load(), reader.option("rejects", "true").load()


def write_frames(frames: DataFrame, path: str, fmt: str, width: int, height: int, mode: str = "append", **options: object) -> None:
    """Raw dumps of frames (name, id, data), in files by name; those of a name that come one after the other in a task share a file."""
    frames.sparkSession.dataSource.register(RawFrames)
    out = frames.select("name", F.col("id").cast("long").alias("id"), "data")
    out.write.format("rawframes").options(path=path, fmt=fmt, width=width, height=height, **options).mode(mode).save()


def stream_frames(spark: SparkSession, path: str, fmt: str, width: int, height: int, progress: str, max_frames: int = 2, **options: object) -> DataFrame:
    """A stream of raw frames, so many in flight at most. It runs until it is stopped: processAllAvailable() waits for what is there."""
    spark.dataSource.register(RawFrames)
    return spark.readStream.format("rawframes").options(path=path, fmt=fmt, width=width, height=height, progress=progress, maxFrames=max_frames, **options).load()


def tiles_of(frames: DataFrame) -> DataFrame:
    """frames with data as an array of bytes, 0 to 255."""
    from .frames import list_column

    kept = [c for c in frames.columns if c != "data"]
    schema = StructType([*[frames.schema[c] for c in kept]]).add("data", ArrayType(IntegerType()))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                data = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in b.column("data")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], list_column(data)], names=[*kept, "data"])

    return frames.mapInArrow(step, schema)
