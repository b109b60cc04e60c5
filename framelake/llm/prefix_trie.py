"""The trie of all conversations' prefixes, built by the recursion of van Emde Boas.

Sequences are cut at half of their depth: what leads to the cut is the upper trie, and each different
way there, a cut prefix, is the root of a lower forest. Both are cut in half again, and all pieces of one
size are treated side by side, so that the rounds follow the logarithm of the longest conversation.

Going up, blocks of two turns, then four and so on get names from those of their halves. Going down, a
cut prefix is named by its forest's root and the block that leads there, so equal prefixes have equal
names wherever they stand. Totals then come back: what a lower forest holds is grafted on the nodes that
lead to its cut, first within pieces of two turns, then of four, and so on.

A name is 128 bits of SHA-256 over what it stands for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered
from .rows import named
from .store import cut, drop, partitions

#: Turns that a conversation may take over from another, and how many conversations share that other.
HEAD, FAMILY = 4, 20

_WORD = r"[^\x20\x09-\x0D]+"
_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _root() -> Column:
    return F.lit(hashlib.sha256(b"").digest()[:16])


# --- sequences ---------------------------------------------------------------------------------


def turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, place, name, tokens), (conv, n)): each conversation's turns in order, from place 0; texts are read once and not moved.

    Turns of one number are ordered by role and digest. Rows are placed over all conversations at
    once, so a long one is many tasks.
    """
    role, text = F.coalesce(named("role"), F.lit("")), F.coalesce(named("text"), F.lit(""))
    name = _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    row = F.struct(named("conv_id").cast("long").alias("conv"), named("turn").alias("turn"), role.alias("role"), name.alias("name"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("tokens"))
    placed = numbered(df.where(named("conv_id").isNotNull()).select(row.alias("t")), "at").select("t.conv", "t.name", "t.tokens", "at")
    size = placed.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    size = cut(size, "conversations")
    return placed.join(size, "conv").select("conv", (F.col("at") - F.col("first")).alias("place"), "name", "tokens"), size.select("conv", "n")


def rebuilt(turn: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, name, tokens), depth from 1: the first turns of another conversation, then one's own."""
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    heads = turn.where((F.col("conv") % FAMILY == 0) & (F.col("place") < HEAD - 1)).groupBy(F.col("conv").alias("donor"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "name", "tokens"))).alias("lead"))  # of HEAD - 1 turns at most
    plan = convs.select("conv", head.alias("head"), (F.col("conv") - F.col("conv") % FAMILY).alias("donor")).join(heads, "donor", "left")
    plan = plan.select("conv", "head", F.filter(F.coalesce("lead", F.array().cast(heads.schema["lead"].dataType)), lambda t: t["place"] < F.col("head")).alias("lead"))
    taken = plan.select("conv", F.inline("lead")).select("conv", (F.col("place") + 1).alias("depth"), "name", "tokens")
    own = turn.join(plan.select("conv", "head", F.size("lead").alias("given")), "conv").where("place >= head")
    return taken.unionByName(own.select("conv", (F.col("place") - F.col("head") + F.col("given") + 1).alias("depth"), "name", "tokens"))


# --- names -------------------------------------------------------------------------------------


def _blocks(rows: DataFrame) -> list[DataFrame]:
    """(conv, at, name, tokens) of whole aligned blocks of 1, 2, 4, ... turns; tokens are those of a block's last turn."""
    out = [cut(rows.select("conv", (F.col("depth") - 1).alias("at"), "name", "tokens"), "blocks")]
    while True:
        pair = out[-1].groupBy("conv", F.shiftright("at", 1).alias("pair"))
        ends = pair.agg(F.count("*").alias("n"), F.min_by("name", "at").alias("a"), F.max_by("name", "at").alias("b"), F.max_by("tokens", "at").alias("tokens"))
        larger = cut(ends.where("n = 2").select("conv", F.col("pair").alias("at"), _digest("a", "b").alias("name"), "tokens"), "blocks")
        if not larger.head(1):
            return out
        out.append(larger)


def prefixes(rows: DataFrame) -> tuple[DataFrame, int]:
    """((conv, depth, name, tokens) of every prefix of every conversation, size of the largest piece)."""
    blocks, parts = _blocks(rows), []
    for level in reversed(range(len(blocks))):
        upper = blocks[level].where("at % 2 = 0")
        depth = F.shiftleft(F.col("at") + 1, level).alias("depth")
        first = upper.where("at = 0").select("conv", depth, _digest(_root(), F.col("name")).alias("name"), "tokens")
        if parts:
            cuts = parts[0]
            for p in parts[1:]:
                cuts = cuts.unionByName(p)
            cuts = cuts.select("conv", F.shiftright("depth", level).alias("at"), F.col("name").alias("root"))
            lower = upper.where("at > 0").join(cuts, ["conv", "at"]).select("conv", depth, _digest("root", "name").alias("name"), "tokens")
            first = first.unionByName(lower)
        parts.append(cut(first, "prefixes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for b in blocks:
        drop(b)
    return out, 1 << len(blocks)


# --- totals ------------------------------------------------------------------------------------


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, name, parent, conv, n_convs, n_children, saved): one row for each different prefix, saved of itself alone."""
    nodes = cut(paths.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("tokens").alias("tokens")), "nodes")
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    deep = nodes.where("depth > 1").join(above, ["conv", "depth"])
    tree = deep.unionByName(nodes.where("depth = 1").withColumn("parent", _root()))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).select(F.lit(0).cast("long").alias("depth"), _root().alias("name"), "conv", "n_convs", F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("binary").alias("parent"))
    tree = cut(tree.unionByName(root), "tree")
    drop(nodes)
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("tokens")).alias("saved")
    return cut(tree.join(children, "name", "left").select("depth", "name", "parent", "conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved), "tree")


def _grafts(tree: DataFrame, paths: DataFrame, size: int) -> DataFrame:
    """(name, leaves, saved) that lower forests give to the nodes above them; a node has a row for each size of pieces at most.

    In a round nodes know what they hold within their piece of s turns. Of two pieces one below the
    other, the forests under a cut are summed up by the node at the cut, and each of these sums goes to
    the nodes that lead there: the places of one conversation in the upper piece.
    """
    known = tree.where("depth > 0").select("name", "parent", "depth", "conv", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    given = []
    for s in (1 << i for i in range(size.bit_length() - 1)):
        below = known.where(f"(depth - 1) % {2 * s} = {s}").groupBy(F.col("parent").alias("cut"))
        forest = below.agg(F.min("conv").alias("conv"), (F.min("depth") - 1).alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        forest = forest.select("conv", F.expr(f"(at - 1) div {s}").alias("piece"), "leaves", "saved")
        upper = paths.where(f"(depth - 1) div {s} % 2 = 0").select("conv", F.expr(f"(depth - 1) div {s}").alias("piece"), "name")
        got = cut(upper.join(forest, ["conv", "piece"]).groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "grafts")
        given.append(got)
        more = got.select("name", F.col("leaves").alias("l"), F.col("saved").alias("s"))
        tops = known.where(f"(depth - 1) % {2 * s} = 0").join(more, "name", "left")
        known = cut(tops.select("name", "parent", "depth", "conv", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "tops")
    whole = known.where("depth = 1").groupBy(F.col("parent").alias("name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    for g in given:
        whole = whole.unionByName(g)
    return whole


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the numbers of the conversations that end at a node, in order.

    The list of a node may be as long as the table: it passes through a task in order and is never held.
    """
    last = paths.groupBy("conv").agg(F.max_by("name", "depth").alias("name"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("name", _root()).alias("name"), "conv")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, hashlib.sha256()
        done: list[tuple[bytes, str]] = []
        for b in batches:
            names, numbers = b.column("name").to_pylist(), b.column("conv").to_pylist()
            start = 0
            while start < len(names):
                end = start + 1
                while end < len(names) and names[end] == names[start]:
                    end += 1
                if names[start] != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest, comma = names[start], hashlib.sha256(), ""
                digest.update((comma + ",".join(map(str, numbers[start:end]))).encode())
                start, comma = end, ","
            yield _digests(done)
            done = []
        if name is not None:
            yield _digests([(name, digest.hexdigest())])

    n = partitions(convs.sparkSession)
    return ends.repartition(n, "name").sortWithinPartitions("name", "conv").mapInArrow(step, "name binary, ends_sha256 string")


def _digests(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["name", "ends_sha256"])


def prefix_trie(df: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations of (conv_id, turn, role, text); see the columns in _SCHEMA.

    Null roles and texts are empty, null turns come first, turns of one number are ordered by role and
    digest. Rows without conv_id are in no conversation. Repeated rows are turns like others. Without
    conversations there is no root. Other columns don't matter.
    """
    spark = df.sparkSession
    turn, convs = turns(df)
    if not convs.head(1):
        return spark.createDataFrame([], _SCHEMA)
    paths, size = prefixes(rebuilt(turn, convs))
    tree = _nodes(paths, convs)
    own = tree.select("name", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    totals = own.unionByName(_grafts(tree, paths, size)).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    first = convs.agg(F.min("conv")).first()[0]
    parents = tree.where("depth > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    deep = tree.where("depth > 1").join(parents, "parent").drop("parent")
    top = tree.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first))).drop("parent")
    out = deep.unionByName(top).drop("saved").join(totals, "name").join(_ends(paths, convs), "name", "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
