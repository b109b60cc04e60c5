"""Documents in fixed blocks, and lookups of 64-bit hashes between blocks.

A block is a few MB of documents in a written table, so its rows never change. It sends its
hashes, each once and in order, to buckets by their highest bits; a bucket answers with one value
for each hash it was sent, in the same order. Neither needs an address for each hash, and a hash
that stands in a third of all documents reaches its bucket once from each block.

Where there are more than FAN buckets, hashes go in two hops and answers come back over both: a
block writes a row for each of FAN ranges of buckets, and a group of blocks then one for each
bucket. A group has as many blocks as a range has buckets, so either hop has FAN rows a block,
whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import cut, cut_bucketed, partitions, text_bytes

#: About so many bytes of text make a block, at least and at most; a longer text is a block of its own.
BLOCK_BYTES, LARGE_BLOCK_BYTES = 8_000_000, 64_000_000
#: Hashes of so many bytes of text go to one bucket on average, at most.
BUCKET_BYTES = 32_000_000
#: Rows that a block writes in a hop, at most.
FAN = 1000
#: A table of blocks has so many buckets at most, or as many as shuffles have partitions; a task takes its blocks one by one.
TABLE_BUCKETS = 20_000


class Route(NamedTuple):
    """Where hashes go: `ranges` ranges of `each` buckets, by way of `groups` groups of blocks where each > 1."""

    ranges: int
    each: int
    groups: int


def sizes(spark: SparkSession, total: int) -> tuple[int, Route, int]:
    """(bytes of a block, route, buckets of the table of blocks) for so many bytes of text.

    Blocks grow with the square root of the input up to a bound; a bucket never gets more than one
    task can hold.
    """
    block = min(LARGE_BLOCK_BYTES, max(BLOCK_BYTES, int(25 * total**0.5)))
    wanted = -(-total // BUCKET_BYTES)
    ranges = min(FAN, max(partitions(spark), wanted))
    each = max(1, -(-wanted // ranges))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return block, Route(ranges, each, max(1, -(-total // (block * each)))), min(most, max(partitions(spark), min(wanted, TABLE_BUCKETS)))


def to_blocks(docs: DataFrame, text: str, name: str) -> tuple[DataFrame, Route]:
    """docs with block and ord (the row's place in it), in a table that is bucketed by block; and the route of its hashes."""
    block_bytes, route, buckets = sizes(docs.sparkSession, text_bytes(docs, text))
    schema = T.StructType([*docs.schema.fields, T.StructField("block", T.LongType()), T.StructField("ord", T.IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, at = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            of, place = [], []
            for n in pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist():
                if size and size + n > block_bytes or at >= 50_000:
                    block, size, at = block + 1, 0, 0
                of.append(block)
                place.append(at)
                size, at = size + n, at + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64()), pa.array(place, pa.int32())], names=[*batch.schema.names, "block", "ord"])

    return cut_bucketed(docs.mapInArrow(number, schema), name, "block", buckets), route


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("ord").combine_chunks()


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def slices(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n buckets in sorted hashes."""
    return np.searchsorted(_buckets(hashes, n), np.arange(n + 1, dtype=np.uint64))


def _encoded(values: np.ndarray) -> bytes:
    return (np.packbits(values) if values.dtype == bool else values).tobytes()


def _decoded(data: bytes, n: int, dtype: type) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool) if dtype is bool else np.frombuffer(data, dtype)


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ask(block: int, hashes: np.ndarray, route: Route, *columns: np.ndarray, ragged: tuple = ()) -> pa.Table:
    """What a block sends: its sorted hashes without repeats, with further columns, by range of buckets.

    Of the columns in ragged each hash has as many values as the first column says.
    """
    at = slices(hashes, route.ranges)
    cuts = [at] * len(columns) + ([_bounds(columns[0])[at]] * len(ragged) if ragged else [])
    some = [k for k in range(route.ranges) if at[k] < at[k + 1]]
    out = {"bucket": some, "sender": [block] * len(some), "hashes": [hashes[at[k] : at[k + 1]].tobytes() for k in some]}
    out |= {f"c{i}": [c[x[k] : x[k + 1]].tobytes() for k in some] for i, (c, x) in enumerate(zip([*columns, *ragged], cuts, strict=True))}
    return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("sender", pa.int64()), ("hashes", pa.binary())] + [(f"c{i}", pa.binary()) for i in range(len(cuts))]))


def asked(n_columns: int) -> str:
    return "bucket int, sender long, hashes binary" + "".join(f", c{i} binary" for i in range(n_columns))


def _gathered(questions: DataFrame, route: Route, types: list, ragged: int) -> DataFrame:
    """Questions of each group of blocks by bucket: grp, range, bucket, senders, lengths (hashes of each sender), hashes and columns."""
    names = [f"c{i}" for i in range(len(types))]
    schema = "grp long, range int, bucket int, senders binary, lengths binary, hashes binary" + "".join(f", {c} binary" for c in names)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def split(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("sender")
        senders = table.column("sender").to_numpy()
        hashes = _joined(table.column("hashes"), np.uint64)
        sender = np.repeat(np.arange(len(senders)), [len(x) // 8 for x in table.column("hashes").to_pylist()])
        grp, within = key[0].as_py(), key[1].as_py()
        local = _buckets(hashes, route.ranges * route.each).astype(np.int64) - within * route.each
        order = np.argsort(local, kind="stable")  # a sender's stay in order
        at = np.searchsorted(local[order], np.arange(route.each + 1))
        lengths = np.bincount(local * len(senders) + sender, minlength=route.each * len(senders)).astype(np.int32).reshape(route.each, -1)
        columns, cuts = [hashes[order]], [at]
        for i, t in enumerate(types):
            values = _joined(table.column(f"c{i}"), t)
            if i == 0:
                runs = values.astype(np.int64)
            if i < len(types) - ragged:
                columns.append(values[order])
                cuts.append(at)
            else:
                to = _bounds(runs[order])
                columns.append(values[np.repeat(_bounds(runs)[:-1][order] - to[:-1], runs[order]) + np.arange(to[-1])])
                cuts.append(to[at])
        some = [k for k in range(route.each) if at[k] < at[k + 1]]
        out = [[grp] * len(some), [within] * len(some), [within * route.each + k for k in some], [senders.tobytes()] * len(some), [lengths[k].tobytes() for k in some]]
        out += [[c[x[k] : x[k + 1]].tobytes() for k in some] for c, x in zip(columns, cuts, strict=True)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    groups = questions.withColumn("grp", F.pmod(F.xxhash64("sender"), F.lit(route.groups)))
    return groups.groupBy("grp", "bucket").applyInArrow(split, schema)


def _handed_out(grouped: DataFrame, dtype: type, schema: str) -> DataFrame:
    """Answers of (grp, range, bucket, senders, lengths, answers) by block: sender, bucket (the range), answers."""

    def split(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        senders = np.frombuffer(table.column("senders")[0].as_py(), np.int64)
        lengths = _joined(table.column("lengths"), np.int32).reshape(-1, len(senders))
        values = np.concatenate([_decoded(x, n, dtype) for x, n in zip(table.column("answers").to_pylist(), lengths.sum(1).tolist(), strict=True)])
        order = np.argsort(np.repeat(np.tile(np.arange(len(senders)), len(lengths)), lengths.ravel()), kind="stable")
        values, at = values[order], _bounds(lengths.sum(0))
        parts = [_encoded(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"sender": senders, "bucket": pa.array([key[1].as_py()] * len(senders), pa.int32()), "answers": pa.array(parts, pa.binary())})

    return grouped.groupBy("grp", "range").applyInArrow(split, schema)


def answer(questions: DataFrame, route: Route, types: list, gives: type, reduce: Callable, more: str = "", extra: Callable | None = None, ragged: int = 0) -> DataFrame:
    """(sender, bucket, answers) and the columns of more.

    reduce gets a bucket's hashes, for each a number that rises with its sender's, and the columns
    (the last ones are ragged), and returns a value of type `gives` for each hash. extra gets these
    and the values, and returns one row of the columns of more, which stands without a sender.
    """
    back = "sender long, bucket int, answers binary"
    far = route.each > 1
    schema = ("grp long, range int, bucket int, senders binary, lengths binary, answers binary" if far else back) + (f", {more}" if more else "")
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    kept = ["grp", "range", "bucket", "senders", "lengths"] if far else ["sender", "bucket"]
    added = arrow.names[len(kept) + 1 :]

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by(kept[0])
        counts = np.array([len(x) // 8 for x in table.column("hashes").to_pylist()])
        ids, lengths = (_joined(table.column("senders"), np.int64), _joined(table.column("lengths"), np.int32)) if far else (table.column("sender").to_numpy(), counts)
        given = [_joined(table.column("hashes"), np.uint64), np.repeat(np.unique(ids, return_inverse=True)[1].astype(np.int32), lengths)]
        given += [_joined(table.column(f"c{i}"), t) for i, t in enumerate(types)]
        values = reduce(*given).astype(gives, copy=False)
        at = _bounds(counts)
        out = table.select(kept).append_column("answers", pa.array([_encoded(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        for i in range(len(added)):
            out = out.append_column(arrow.field(len(kept) + 1 + i), pa.nulls(out.num_rows, arrow.field(len(kept) + 1 + i).type))
        if extra:
            row = dict(zip(added, extra(*given, values), strict=True))
            out = pa.concat_tables([out.cast(arrow), pa.Table.from_pylist([row], arrow)])
        return out.cast(arrow)

    if not far:
        return questions.groupBy("bucket").applyInArrow(of, schema)
    found = _gathered(questions, route, types, ragged).groupBy("bucket").applyInArrow(of, schema)
    if not extra:
        return _handed_out(found, gives, back)
    found = cut(found, "found")
    out = _handed_out(found.where("grp is not null"), gives, back)
    return out.unionByName(found.where("grp is null").select(F.lit(None).cast("long").alias("sender"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("answers"), *added), allowMissingColumns=True)


def answers(table: pa.Table, hashes: np.ndarray, route: Route, dtype: type) -> np.ndarray:
    """The values for a block's sorted hashes, from the rows that came back to it."""
    at = slices(hashes, route.ranges)
    out = np.zeros(len(hashes), dtype)
    for bucket, x in zip(table.column("bucket").to_pylist(), table.column("answers").to_pylist(), strict=True):
        out[at[bucket] : at[bucket + 1]] = _decoded(x, at[bucket + 1] - at[bucket], dtype)
    return out


def by_block(blocks: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").applyInArrow(lambda table: function(in_order(table)), schema)


def with_answers(blocks: DataFrame, back: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """function gets each block and what came back to it."""
    columns = [c for c in back.columns if c != "sender"]
    replies = back.where("sender is not null").select(F.col("sender").alias("block"), *columns)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda left, right: function(in_order(left), right), schema)
