"""Approximate nearest neighbours by inner product: inverted lists, and an adaptive scan of dimensions within them.

Every row is in the list of the direction that it is nearest to; a query looks through the lists whose
mean vectors promise most. Vectors are rotated at random and laid out in blocks of columns. After each
block a hypothesis test asks whether a candidate, by the part of its distance seen so far, can still be
among a query's best, and most are abandoned early. Who comes through is scored on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import add_columns, named
from .store import cut
from .vectors import finite, lists, matrix, typical_length

#: What is fitted on: so many rows chosen by hash, and fewer where they would take more bytes than this.
SAMPLE, SAMPLE_BYTES = 16384, 64 << 20
#: At most so many lists; the square root of the number of rows below that.
LISTS = 1024
#: Lists are probed until so many of the sample's true neighbours would be found; the sample is thinner than the table, so the table's share is higher.
RECALL, CALIBRATION = 0.95, 256
#: A task's share of a list: so many bytes of candidates against so many queries.
CELL_BYTES, PART = 4 << 20, 262144
#: Candidates are taken up so many at a time, with what was found so far as the mark to beat; queries so many at a time.
ROWS, QUERIES = 4096, 64
#: Width of the test: a candidate is abandoned where its distance, estimated from the first d dimensions, is more than 1 + EPSILON / sqrt(d) times too far.
EPSILON = 2.1
#: Survivors are scored so many at a time.
PAIRS = 1 << 16

_FOUND = "query long, query_id long, id long, score double"


def column_blocks(width: int) -> list[tuple[int, int]]:
    """Ends of the blocks of columns; each test sees about twice the dimensions of the one before."""
    ends = [0, min(16, width)]
    while ends[-1] < width:
        ends.append(min(width, 2 * ends[-1]))
    return list(zip(ends[:-1], ends[1:], strict=True))


def rotation(width: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _directions(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-30)).astype(np.float32)


def nearest_list(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(_directions(x[i : i + 4096]) @ centres.T).argmax(1) for i in range(0, len(x), 4096)]])


def fit(x: np.ndarray, n_lists: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(directions of the lists, mean vectors of the lists, lists to probe) from a sample."""
    rng = np.random.default_rng(seed)
    unit = _directions(x)
    centres = unit[rng.choice(len(unit), n_lists, replace=False)]
    for _ in range(8):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_list(x, centres), unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), unit[rng.choice(len(unit), n_lists)])
    at = nearest_list(x, centres)
    size = np.bincount(at, minlength=n_lists)[:, None]
    sums = np.zeros_like(centres)
    np.add.at(sums, at, x)
    means = np.where(size > 0, sums / np.maximum(size, 1), centres)
    asked = rng.choice(len(x), min(CALIBRATION, len(x)), replace=False)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, : min(k, len(x) - 1)]
    turn = np.argsort(np.argsort(-(x[asked] @ means.T), axis=1), axis=1)
    seen = np.bincount(np.take_along_axis(turn, at[best], axis=1).ravel(), minlength=n_lists).cumsum()
    return centres, means, int(np.searchsorted(seen, RECALL * max(1, seen[-1]))) + 1


class Best:
    """The k best of each query so far, of equals those of smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.query, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.mark = np.full(n, -np.inf)

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        query, id_, score = np.concatenate([self.query, query]), np.concatenate([self.id, id_]), np.concatenate([self.score, score])
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.id, self.score = query[keep], id_[keep], score[keep]
        full = place[keep] == self.k - 1
        self.mark[self.query[full]] = self.score[full]


def survivors(q: list[np.ndarray], x: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs whose squared distance stays below limit (queries, candidates), by tests after each block of columns.

    Distances are dense sums while many pairs are alive and are then carried on for these pairs alone.
    """
    width, seen, pairs = sum(b.shape[1] for b in x), 0, None
    part = np.zeros(limit.shape, np.float32)
    alive = np.ones(limit.shape, bool)
    for a, b in zip(q, x, strict=True):
        seen += b.shape[1]
        slack = 1.0 if seen == width else seen / width * (1 + EPSILON / np.sqrt(seen)) ** 2
        if pairs is None:
            part += (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            alive &= ~(part > slack * limit)  # what overflows is left to the exact score
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                held, most = part[pairs], limit[pairs]
        else:
            held = held + np.square(a[pairs[0]] - b[pairs[1]]).sum(1)
            keep = ~(held > slack * most)
            pairs, held, most = (pairs[0][keep], pairs[1][keep]), held[keep], most[keep]
    return np.nonzero(alive) if pairs is None else pairs


def scan(q: np.ndarray, q_row: np.ndarray, mark: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, turn: np.ndarray, k: int) -> Best:
    """The best k of candidates x for each query q, but for the query's own row; mark is the score that must be reached."""
    best = Best(len(q), k)
    best.mark = mark.copy()
    ends = column_blocks(q.shape[1])
    for i in range(0, len(x), ROWS):
        near = x[i : i + ROWS].astype(np.float32)
        turned = near @ turn
        blocks, far = [np.ascontiguousarray(turned[:, a:b]) for a, b in ends], np.square(near).sum(1)
        for j in range(0, len(q), QUERIES):
            own = q[j : j + QUERIES].astype(np.float32)
            asked, length = own @ turn, np.square(own).sum(1)[:, None]
            with np.errstate(over="ignore"):
                limit = np.maximum(0, length + far - 2 * best.mark[j : j + QUERIES, None].astype(np.float32)) + 1e-5 * (length + far)
            at, to = survivors([np.ascontiguousarray(asked[:, a:b]) for a, b in ends], blocks, limit)
            for p in range(0, len(at), PAIRS):
                a, b = at[p : p + PAIRS] + j, to[p : p + PAIRS] + i
                other = q_row[a] != x_row[b]
                a, b = a[other], b[other]
                score = (q[a].astype(np.float64) * x[b].astype(np.float64)).sum(1)
                reached = score >= best.mark[a]
                best.add(a[reached], x_id[b[reached]], score[reached])
    return best


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is a query its k nearest other rows by inner product, from rank 1.

    score is the inner product of the original vectors in double precision; of equals the smaller
    vec_id comes first. Rows alike are rows apart: a repeated query is answered once for each of its
    rows, and its copies are among the answers. Null keys and vectors that are null, zero, hold null
    or non-finite components or have another length than most take no part; without others a query
    has no answer. Other columns and their names don't matter.

    Shuffled are the vectors, once by list and once more to meet queries from other lists, and each
    query once for each probed cell. A cell is a bounded part of a list, so a crowded list is many
    tasks; the queries that come to a cell are dealt out over parts of bounded size.
    """
    spark = df.sparkSession
    rows = df.select(named(key).cast("long").alias("id"), named(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & finite("v") & F.expr("exists(v, e -> e <> 0)"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width, n = typical_length(rows, "v")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width)
    most = max(2, min(sample, SAMPLE_BYTES // (4 * width)))
    share = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
    fitted = np.array(rows.where(share).select("v").toPandas()["v"].tolist(), np.float32).reshape(-1, width)[:most]
    n_lists = max(1, min(LISTS, round(n**0.5), len(fitted) // 4))
    if len(fitted) < 2:
        fitted, n_lists = np.eye(2, width, dtype=np.float32) + 1, 1  # too few rows to choose from: one list holds them all
    model = spark.sparkContext.broadcast((rotation(width, seed), *fit(fitted, n_lists, k, seed)))

    listed = cut(add_columns(rows, "list int", lambda b: [nearest_list(matrix(b.column("v"), width).astype(np.float32), model.value[1])]), "lists")
    sizes = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    per_cell = max(1, CELL_BYTES // (4 * width))
    cells = np.array([-(-sizes.get(i, 0) // per_cell) for i in range(n_lists)])
    first = np.concatenate([[0], cells.cumsum()])
    places = spark.createDataFrame([(i, int(first[i]), int(cells[i])) for i in range(n_lists)], "list int, first int, cells int")
    held = listed.join(F.broadcast(places), "list").select("row", "id", "v", "asks", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("cells"))).cast("int").alias("cell"))
    kind = held.schema["v"].dataType.simpleString()

    def at_home(t: pa.Table) -> pa.Table:
        """Queries against their own cell, the mark that this sets, and the cells that they go to next."""
        turn, _, means, probes = model.value
        x, row, id_, asks = matrix(t["v"], width), t["row"].to_numpy(), t["id"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        q = x[asks]
        best = scan(q, row[asks], np.full(len(q), -np.inf), x, row, id_, turn, k)
        wanted = np.argsort(-(q.astype(np.float32) @ means.T), axis=1, kind="stable")[:, :probes]
        own = t["cell"][0].as_py()
        to = [[c for at in w for c in range(first[at], first[at + 1]) if c != own] for w in wanted.tolist()]
        ends = np.searchsorted(best.query, np.arange(len(q) + 1)).astype(np.int32)
        near = pa.StructArray.from_arrays([pa.array(best.id), pa.array(best.score)], names=["id", "score"])
        arrays = [pa.array(row[asks]), pa.array(id_[asks]), lists(q, t["v"].type.value_type), pa.array(best.mark), pa.ListArray.from_arrays(pa.array(ends), near), pa.array(to, pa.list_(pa.int32()))]
        return pa.table(arrays, names=["row", "id", "v", "mark", "near", "to"])

    home = cut(held.groupBy("cell").applyInArrow(at_home, f"row long, id long, v {kind}, mark double, near array<struct<id: long, score: double>>, to array<int>"), "queries")
    parts = 1 + home.count() // PART
    part = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    guests = home.select(F.explode("to").alias("cell"), part.alias("part"), "row", "id", "v", "mark", F.lit(True).alias("asks"))
    hosts = held.select("cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "id", "v", F.lit(None).cast("double").alias("mark"), F.lit(False).alias("asks"))

    def abroad(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        v, row, id_ = matrix(t["v"], width), t["row"].to_numpy(), t["id"].to_numpy()
        best = scan(v[asks], row[asks], t["mark"].to_numpy(zero_copy_only=False)[asks], v[~asks], row[~asks], id_[~asks], model.value[0], k)
        return pa.table([row[asks][best.query], id_[asks][best.query], best.id, best.score], names=["query", "query_id", "id", "score"])

    met = guests.unionByName(hosts).groupBy("cell", "part").applyInArrow(abroad, _FOUND)
    found = home.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.inline("near")).unionByName(met)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
