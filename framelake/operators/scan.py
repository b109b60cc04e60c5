"""Prefix scans over segments of sorted rows, however many tasks the rows of one key need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import written

#: Rows that a range partition holds on average, at most.
ROWS = 2_000_000


def _changes(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's keys differ from those of the row before, which may be that of an earlier batch; nulls are equal."""
    out = np.zeros(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k)
        before = last.column(k) if last is not None else column.slice(0, 1)
        shifted = pa.concat_arrays([before, column.slice(0, batch.num_rows - 1)])
        other = pc.fill_null(pc.not_equal(column, shifted), pc.xor(pc.is_null(column), pc.is_null(shifted)))
        out |= np.asarray(pc.fill_null(other, False).to_numpy(zero_copy_only=False), bool)
    return out


class _Open:
    """The segment that a task's last row stands in: its numbers so far, and what it carries."""

    def __init__(self, carried: int, after: bool) -> None:
        self.after, self.run, self.segment, self.place, self.edge = after, 0, 0, 0, False
        self.values: list = [None] * carried

    def take(self, change: np.ndarray, edge: np.ndarray, counts: np.ndarray, carried: list[pa.Array]) -> tuple[list[np.ndarray], list[pa.Array]]:
        """(run, segment, place) of a batch's rows and what their segments carry; places count the row itself."""
        n, at = len(change), np.arange(len(change))
        opens = np.concatenate([[self.edge], edge[:-1]]) & ~change if self.after else edge
        run = self.run + change.cumsum()
        begin, head = (np.maximum.accumulate(np.where(x, at, -1)) for x in (change, change | opens))  # -1: in an earlier batch
        before, total = (np.concatenate([[0], x.cumsum()]) for x in (opens, counts))
        segment = before[1:] - np.where(begin < 0, -self.segment, before[np.maximum(begin, 0)])
        place = total[1:] - np.where(head < 0, -self.place, total[np.maximum(head, 0)])
        source = np.where(head < 0, n, np.where(opens[np.maximum(head, 0)], head, n + 1))  # a segment that no edge opens carries nothing
        values = [pc.take(pa.concat_arrays([c, pa.array([v, None], c.type)]), pa.array(source)) for c, v in zip(carried, self.values, strict=True)]
        self.run, self.segment, self.place, self.edge = int(run[-1]), int(segment[-1]), int(place[-1]), bool(edge[-1])
        self.values = [v[n - 1].as_py() for v in values]
        return [run, segment, place], values


def segmented_scan(df: DataFrame, keys: list[str], order: list[str], edge: Column, counts: Column | None = None, after: bool = False, carry: dict[str, Column] | None = None) -> DataFrame:
    """df with segment and place: within the rows of equal keys, in order, edges separate segments.

    segment is the number of edges so far: an edge is the first row of its segment, or with `after` the
    last. place is the number of rows (for which counts holds) of the segment before this row. Without
    `after`, carry adds columns that hold a value of the row that opened the segment, null before the
    first edge. Columns of df with one of these names are replaced. Null keys are equal, null edges and counts are false; order must be total for the result
    to be the same in each run.

    Rows are written, so that they are made once and counted, sorted in range partitions of ROWS or
    fewer on average and scanned once where they are; no task needs all rows of a key. Each partition then tells in one row how it begins and ends. These rows, as many as partitions,
    give what is carried into each, which is added where the first key of a partition goes on.
    """
    carry = carry or {}
    spark, own = df.sparkSession, [c for c in df.columns if c not in {"segment", "place", *carry}]
    named = lambda c: F.col(f"`{c}`")
    at_keys, sorts, values = {f"k{i}": named(k) for i, k in enumerate(keys)}, {f"o{i}": named(o) for i, o in enumerate(order)}, {f"c{i}": e for i, e in enumerate(carry.values())}
    flags = {"edge": F.coalesce(edge, F.lit(False)), "counts": F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))}
    rows = df.select(F.struct(*[named(c) for c in own]).alias("row"), *[e.alias(c) for c, e in {**at_keys, **sorts, **flags, **values}.items()])
    rows = written(rows, "unsorted")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    ranged = rows.repartitionByRange(n, *at_keys, *sorts).sortWithinPartitions(*at_keys, *sorts).drop(*sorts)
    kept, at_keys, values = ["row", *at_keys, "edge", "counts"], list(at_keys), list(values)
    made = [T.StructField(c, T.LongType()) for c in ("at", "run", "segment", "place")] + [T.StructField("part", T.IntegerType())] + [rows.schema[c] for c in values]
    out = T.StructType([rows.schema[c] for c in kept] + made)
    arrow = to_arrow_schema(out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, open_ = TaskContext.get().partitionId(), 0, None, _Open(len(values), after)
        for b in batches:
            if not b.num_rows:
                continue
            edge_, counts_ = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("edge", "counts"))
            numbers, carried = open_.take(_changes(b, at_keys, last), edge_, counts_.astype(np.int64), [b.column(c) for c in values])
            columns = [b.column(c) for c in kept] + [pa.array(x) for x in (seen + np.arange(b.num_rows), *numbers)] + [pa.array(np.full(b.num_rows, part, np.int32))] + carried
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            seen, last = seen + b.num_rows, b.slice(b.num_rows - 1)

    local = written(ranged.mapInArrow(scan, out), "scanned")
    first = (F.col("run") == 0) & F.col("goes_on")
    still = first & (F.col("segment") == 0)  # no edge in this partition yet
    fixed = {"segment": F.col("segment") + F.when(first, F.col("in_segment")).otherwise(0), "place": F.col("place") - F.col("counts").cast("long") + F.when(still, F.col("in_place")).otherwise(0)}
    fixed |= {name: F.when(still, F.col(f"in_{c}")).otherwise(F.col(c)) for name, c in zip(carry, values, strict=True)}
    return local.join(F.broadcast(_carried(local, at_keys, values, after)), "part").select(*[F.col(f"row.`{c}`").alias(c) for c in own], *[e.alias(c) for c, e in fixed.items()])


def _carried(local: DataFrame, keys: list[str], carry: list[str], after: bool) -> DataFrame:
    """(part, goes_on, in_*): what the rows before a partition leave open, a row each."""
    closes = F.col("edge") & F.lit(after)  # the partition's last row ends its segment
    tail = F.struct("run", *keys, "segment", "place", closes.alias("closes"), *carry)
    ends = local.groupBy("part").agg(F.min_by(F.struct(*keys), "at").alias("first"), F.max_by(tail, "at").alias("last"))
    none = {"keys": None, "segment": 0, "place": 0, "values": [None] * len(carry)}
    out, before = [], none
    for part, first, last in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a partition
        goes_on = tuple(first) == before["keys"]
        into = before if goes_on else none
        out.append((part, goes_on, into["segment"], into["place"], *into["values"]))
        single = last["run"] == 0
        same = single and last["segment"] == 0  # still in the segment that came in
        before = {
            "keys": tuple(last[k] for k in keys), "segment": last["segment"] + last["closes"] + (into["segment"] if single else 0),
            "place": 0 if last["closes"] else last["place"] + (into["place"] if same else 0), "values": into["values"] if same else [last[c] for c in carry],
        }
    fields = [("part", T.IntegerType()), ("goes_on", T.BooleanType()), ("in_segment", T.LongType()), ("in_place", T.LongType()), *((f"in_{c}", local.schema[c].dataType) for c in carry)]
    return local.sparkSession.createDataFrame(out, T.StructType([T.StructField(*f) for f in fields]))


def parse_fmap_log(lines: DataFrame, marker: str = r"^Feature map (\d+):$") -> DataFrame:
    """(file, map, pos, v) of text dumps (file, line, text): a marker line starts a map, blank lines don't count.

    A map's header is carried on over range partitions of lines, so a file may be of any length.
    """
    starts = F.col("text").rlike(marker)
    value = ~starts & (F.trim("text") != "")
    number = F.when(starts, F.regexp_extract("text", marker, 1).cast("int"))
    sections = segmented_scan(lines, ["file"], ["line"], starts, counts=value, carry={"map": number})
    return sections.where(value & (F.col("segment") > 0)).select("file", "map", F.col("place").alias("pos"), F.col("text").cast("double").alias("v"))
