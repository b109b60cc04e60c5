"""Row-wise Arrow steps that add columns and keep all others, and rows whose names clash with nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def named(column: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less its columns of these names; case doesn't count, as in Spark."""
    gone = {x.lower() for x in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in gone])


class Packed:
    """A table as the columns that an operator works on and one struct, rest, of all others.

    df has the columns of `used` under their new names and rest, whose fields are named by place.
    No name of the table's can clash with one that the operator makes.
    """

    def __init__(self, docs: DataFrame, **used: str) -> None:
        self.columns = docs.columns
        self.at = {old: new for new, old in used.items()}
        self.place = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in self.at)}
        rest = F.struct(F.lit(0).alias("none"), *[named(c).alias(x) for c, x in self.place.items()])
        self.df = docs.select(*[named(old).alias(new) for new, old in used.items()], rest.alias("rest"))

    def unpack(self, df: DataFrame, *more: Column, less: str | None = None, **replaced: Column) -> DataFrame:
        """The table's columns of df in their order, but for `less`, and more; a column of a name in `replaced` has that value."""
        old = lambda c: F.col(self.at[c]) if c in self.at else F.col(f"rest.{self.place[c]}")
        return df.select(*[(replaced[c] if c in replaced else old(c)).alias(c) for c in self.columns if c != less], *more)

    def tie(self) -> Column:
        """A number that tells rows alike in the used columns apart by the others."""
        return F.xxhash64(F.to_json("rest"))


def add_columns(df: DataFrame, fields: str, function: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df with the columns that function makes of each batch; a column of such a name is replaced."""
    new = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    kept = without(df, new.names)
    out = T.StructType(kept.schema.fields + new.fields)
    arrow = to_arrow_schema(new)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(function(batch), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *arrow.names])

    return kept.mapInArrow(step, out)
