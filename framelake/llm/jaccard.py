"""Near-duplicates by exact Jaccard similarity of shingles of five words.

Texts at similarity 0.8 differ in about ten bits of a SimHash of 64, beyond the reach of the keys of
simhash.py. So bands of minima propose pairs: two texts share a key if all ROWS minima of one of
BANDS bands agree, which at similarity 0.8 fails once in 2e7 pairs, at 0.9 never in practice. Each
proposed pair is then held against the texts' whole shingle sets, so only pairs at SIMILARITY or
more are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spread
from .rows import Packed, add_columns
from .store import cut
from .textops import BLANKS, lower, mix, pieces, separators, window_hashes, word_hashes, words

#: Words of a shingle and the least similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: MinHash bands and minima of each: a pair at similarity s shares no key with probability (1 - s**ROWS)**BANDS.
BANDS, ROWS = 32, 4

_U = np.uint64
_BLANK = separators(BLANKS)
_FLIP, _TIMES = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ascending, and offsets of the texts in them; a text of fewer words is one shingle."""
    data = lower(data)
    starts, ends, wo = words(data, off, _BLANK)
    h, n = word_hashes(data, starts, ends), np.diff(wo)
    hashes, whole = window_hashes(h, wo, SHINGLE)
    for k in range(1, SHINGLE):
        at = wo[:-1][n == k]
        hashes[at], whole[at] = window_hashes(h, wo, k)[0][at] ^ _U(k), True
    doc, hashes = np.repeat(np.arange(len(n)), n)[whole], hashes[whole]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_hashes(hashes: np.ndarray, so: np.ndarray) -> np.ndarray:
    """One hash (int64) of each set: zero for an empty one."""
    size = np.diff(so)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _FLIP[0]), dtype=np.uint64)])
    return np.where(size > 0, mix(total[so[1:]] - total[so[:-1]] + size.astype(np.uint64)), _U(0)).view(np.int64)


def band_keys(hashes: np.ndarray, so: np.ndarray) -> np.ndarray:
    """(sets that aren't empty, BANDS): keys (int64)."""
    first = so[:-1][np.diff(so) > 0]
    keys = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS if len(first) else 0):
        key = np.full(len(first), _U(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key ^ np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], first))
        keys[:, b] = key
    return keys.view(np.int64)


def _signatures(column: pa.Array) -> list:
    """Hash, size and keys of each text's set."""
    made = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64))]
    for _, _, data, off in pieces(column):
        hashes, so = shingle_sets(data, off)
        made.append((set_hashes(hashes, so), np.diff(so), band_keys(hashes, so)))
    sets, size, keys = (np.concatenate(x) for x in zip(*made, strict=True))
    ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
    return [sets, size, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in pieces(batch.column(0)):
            hashes, so = shingle_sets(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(hashes, so)), pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["set", "hashes"])


def _sets_of(asked: DataFrame, texts: DataFrame, unique: DataFrame) -> DataFrame:
    """(set, hashes) of the sets asked for, of texts (row, text)."""
    rows = unique.join(asked.distinct(), "set").select(F.col("first.row").alias("row"))
    return cut(texts.join(rows, "row").select("text").mapInArrow(_sets, "set long, hashes array<long>"), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, unique: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of sets whose similarity is high enough; texts has (row, text)."""
    pairs = cut(pairs, "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("set")), texts, unique)
    both = pairs.join(sets.select(F.col("set").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("set").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common / (F.size("a") + F.size("b") - common) >= SIMILARITY).select("u", "v")


def _near_in_size(a: str, b: str) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-9


def _prefixes(mixed: DataFrame, texts: DataFrame, unique: DataFrame) -> DataFrame:
    """(set, size, c, shingle, at): the rarest shingles of each set of mixed (set, size, c), as many as two similar sets can't do without, by place.

    Shingles are ordered by how many of the sets hold them. Those that no other set holds are left out.
    """
    shingles = _sets_of(mixed.select("set"), texts, unique).select("set", F.explode("hashes").alias("shingle"))
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    ranked = shingles.join(often, "shingle", "left").select("set", F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle").alias("s"))
    prefix = F.slice(F.array_sort(F.collect_list("s")), F.lit(1), F.count("*").cast("int") - F.ceil(F.count("*") * SIMILARITY - 1e-9).cast("int") + 1)
    rare = ranked.groupBy("set").agg(prefix.alias("p")).select("set", F.posexplode("p").alias("at", "p")).where("p.often > 1")
    return mixed.join(rare, "set").select("set", "size", "c", "p.shingle", "at")


def _apart(mixed: DataFrame, texts: DataFrame, unique: DataFrame) -> DataFrame:
    """(u, v): pairs of mixed (set, size, c) of two components that can be similar enough; none that is, is left out.

    Two such sets have a first common shingle, in the order of rarity, among the rarest of each (prefix
    filter), and enough shingles behind it (positional filter). Texts that share a common passage and
    differ in more than a fifth beside it don't meet.
    """
    one = cut(_prefixes(mixed, texts, unique), "prefixes")
    other = one.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("set", "size", "c", "at")])
    common = F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("size") + F.col("size2")) - 1e-9
    enough = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) >= common
    pairs = one.join(other, "shingle").where((F.col("set") > F.col("set2")) & (F.col("c") != F.col("c2")) & _near_in_size("size", "size2") & enough)
    return pairs.select(F.col("set").alias("u"), F.col("set2").alias("v")).distinct()


def _stars(shared: DataFrame) -> DataFrame:
    """(u, v): each set of shared (key, set, size, n, lo) with two others of each of its keys, the smallest and the one that meets most sets.

    Copies of one text differ from each other more than from the text. It shares most keys with them, so
    it meets most sets.
    """
    degree = shared.groupBy("set").agg(F.sum("n").alias("met"))
    hub = shared.join(degree, "set").groupBy("key").agg(F.max(F.struct("met", "set", "size")).alias("hub"))
    to_least = shared.select("set", "size", "lo.set", F.col("lo.size").alias("size2")).toDF("set", "size", "set2", "size2")
    to_hub = shared.join(hub, "key").select("set", "size", "hub.set", "hub.size").toDF("set", "size", "set2", "size2")
    pairs = to_least.unionByName(to_hub).where((F.col("set") != F.col("set2")) & _near_in_size("size", "size2"))
    return pairs.select(F.greatest("set", "set2").alias("u"), F.least("set", "set2").alias("v")).distinct()


def link_sets(unique: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) for sets (set, size, keys, first) that link to others; texts has (row, text).

    Members of a key are first held against two of them, which joins large groups in linear work. The
    sets of keys whose members are then still in more than one component go through an exact join.
    """
    members = unique.select("set", "size", F.explode("keys").alias("key"))
    ends = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("set", "size")).alias("lo")).where("n > 1")
    shared = cut(members.join(ends, "key").select("key", "set", "size", "n", "lo"), "keys")
    first = components(_verified(_stars(shared), texts, unique))
    named = shared.select("key", "set", "size").join(first, F.col("set") == F.col("node"), "left").select("key", "set", "size", F.coalesce("root", "set").alias("c"))
    mixed = cut(spread(named, "c").select("set", "size", "c").distinct(), "mixed")
    links = _verified(_apart(mixed, texts, unique), texts, unique)
    return components(links.unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class of near-duplicates with the smallest key, with all its columns.

    Texts link at SIMILARITY or more, and links chain. Null and wordless texts are one class; null
    keys come last. Of rows alike in key and text the one with the smallest hash of its other columns
    stays, of rows alike in all columns one. Rows go by a number of their own in a written table.
    """
    packed = Packed(docs, id=key, text=text)
    whole = cut(packed.df.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = add_columns(whole.select("id", "row", packed.tie().alias("tie"), "text"), "set bigint, size int, keys array<bigint>", lambda b: _signatures(b.column("text"))).drop("text")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "row"))
    unique = cut(rows.groupBy("set").agg(first.alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")), "unique")
    roots = unique.join(link_sets(unique, whole.select("row", "text")), F.col("set") == F.col("node"), "left").select("first", F.coalesce("root", "set").alias("root"))
    kept = roots.groupBy("root").agg(F.min("first").alias("kept")).select("kept.row")
    return packed.unpack(whole.join(kept, "row"))
