"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def _marks(edges: DataFrame) -> tuple:
    """Count and two sums of independent hashes of all edges: they change whenever the edges do, but for one chance in 2**100."""
    hashed = [F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashed).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each u's neighbours above (large) or below it, itself included, get the smallest of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the smallest node that can be reached.

    Rounds end when the edges no longer change; their number grows with the logarithm of the
    number of nodes. Each round is written to the shared folder and the one before it deleted.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    marks = _marks(edges)
    while marks[0]:
        before, last = edges, marks
        edges = cut(_stars(_stars(edges, True), False), "edges")
        marks = _marks(edges)
        drop(before)
        if marks == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def spread(members: DataFrame, value: str) -> DataFrame:
    """members of those keys that have more than one value, with the smallest (lo) and the largest (hi).

    No window: the ends are found with partial sums, and a join may split a key's members over tasks.
    The keys are never broadcast: members made in Python seem fewer to Spark than they are.
    """
    ends = members.groupBy("key").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")
    return members.join(ends.hint("merge"), "key")
