"""SimHash near-duplicates, found by Golay-code fuzzy keys.

64-bit fingerprints are cut into three segments of 22, 21 and 21 bits. A segment, padded to 23
bits and given a parity bit, is decoded to the nearest codewords of the binary Golay code: one,
or the six at distance four. Two segments that differ in at most two bits always share one.
Four differing bits leave a segment with at most two of them beside two unchanged halves of the
other segments, so a key is one codeword index with two exact halves, and fingerprints that
share no key differ in more than four bits. Pairs under a key are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spread
from .rows import Packed, add_columns
from .store import cut, drop
from .textops import BLANKS, lower, pieces, separators, words

#: The Golay code's generator polynomial, and the first bit and length of each segment's halves.
GENERATOR = 0b101011100011
HALVES = (((0, 11), (11, 11)), ((22, 10), (32, 11)), ((43, 10), (53, 11)))
MAX_BITS = 4
#: Members outside a key's largest component that are held against all of its members: no more pairs than the parts of these have rows.
FEW = MAX_BITS + 1
#: Copies of each class's row when members look it up, so that a class of many members isn't one task's.
SALTS = 16

_U = np.uint64
_BLANK = separators(BLANKS)
#: For each byte, its bits in eight counters of eight bits.
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).copy().view(np.uint64).ravel()


def bit_counts(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each bit is set in each run of n > 0 hashes."""
    per = -(-n // 255)  # a counter of eight bits holds 255
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    step = np.arange(per.sum()) - np.repeat(first, per)
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    part = np.add.reduceat(spread, np.repeat(starts, per) + 255 * step, axis=0)
    return np.add.reduceat(part.view(np.uint8).astype(np.int32), first, axis=0)


def fingerprint_array(column: pa.Array, shingle: int = 4) -> np.ndarray:
    """Fingerprint of each text, as int64."""
    out = np.zeros(len(column), np.uint64)
    for i, j, data, off in pieces(column):
        blank = _BLANK[data]
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # the first blank after a word stays
        at = np.concatenate([[0], np.cumsum(keep)])
        data = np.where(blank, np.uint8(32), lower(data))[keep]
        starts, ends, wo = words(data, at[off], _BLANK)
        n_words = np.diff(wo)
        n = np.where(n_words < shingle, np.minimum(n_words, 1), n_words - shingle + 1)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        runs = np.concatenate([[0], np.cumsum(n[has])])
        first = np.repeat(wo[has] - runs[:-1], n[has]) + np.arange(runs[-1])
        last = np.minimum(first + shingle, np.repeat(wo[has + 1], n[has])) - 1
        text = data.tobytes()
        made = map(xxhash.xxh64_intdigest, map(text.__getitem__, map(slice, starts[first].tolist(), ends[last].tolist())), repeat(42))
        hashes = np.fromiter(made, np.uint64, runs[-1])
        bits = 2 * bit_counts(hashes, runs[:-1], n[has]) > n[has, None]
        out[i + has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """docs with fingerprint (bigint): zero for a null text or one without words."""
    return add_columns(docs, "fingerprint bigint", lambda b: [fingerprint_array(b.column(text), shingle)])


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to flip for each of up to six nearest codewords, and how many these are."""

    def syndrome(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for k in range(22, 10, -1):
            w = np.where(w >> k & 1, w ^ (GENERATOR << (k - 11)), w)
        return w

    near = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        flips = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)])
        near[syndrome(flips)] = flips
    single = np.array([1 << i for i in range(23)])
    of = syndrome(single)
    all_, n = np.zeros((2048, 6), np.int64), np.ones(2048, np.int64)
    for s in range(2048):
        all_[s, :] = near[s]
        if bin(near[s]).count("1") == 3:
            found = np.unique(single ^ near[s ^ of])
            all_[s, : len(found)], n[s] = found, len(found)
    return all_, n


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six indices of 12 bits for each segment of up to 23 bits, and how many of them count."""
    flips, n = _decoder()
    rest = segment.copy()
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ (GENERATOR << (k - 11)), rest)
    return (segment[:, None] ^ flips[rest]) >> 11, n[rest]


def _halves(fingerprint: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    bits = fingerprint.view(np.uint64)
    return {(s, h): ((bits >> _U(HALVES[s][h][0])) & _U((1 << HALVES[s][h][1]) - 1)).astype(np.int64) for s in range(3) for h in range(2)}


#: Each kind of key: the segment that is decoded and the two halves that are exact.
KINDS = [(s, a, b) for s in range(3) for a, b in combinations([(t, h) for t in range(3) for h in range(2) if t != s], 2)]


def fuzzy_keys(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (int64)."""
    half = _halves(fingerprint)
    decoded = [codeword_indices(half[s, 0] | half[s, 1] << HALVES[s][0][1]) for s in range(3)]
    rows, keys = [], []
    for kind, (s, a, b) in enumerate(KINDS):
        index, n = decoded[s]
        row, col = np.nonzero(np.arange(6) < n[:, None])
        rows.append(row)
        keys.append(index[row, col] << 24 | half[a][row] << 12 | half[b][row] | kind << 40)
    return np.concatenate(rows), np.concatenate(keys)


def free_parts(key: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
    """(keys, MAX_BITS + 1): the bits that a key leaves free, in parts; of two fingerprints at MAX_BITS one part is equal."""
    half, kind = _halves(fingerprint), key >> 40
    out = np.empty((len(key), MAX_BITS + 1), np.int64)
    for k, (_, a, b) in enumerate(KINDS):
        at = np.flatnonzero(kind == k)
        value, size = np.zeros(len(at), np.int64), 0
        for place in half:
            if place not in (a, b):
                value |= half[place][at] << size
                size += HALVES[place[0]][place[1]][1]
        width = -(-size // (MAX_BITS + 1))
        for i in range(MAX_BITS + 1):
            out[at, i] = value >> i * width & (1 << width) - 1 | i << 16
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 2000):
            row, key = fuzzy_keys(np.ascontiguousarray(fp[i : i + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 2000][row])], names=["key", "fp"])


def _close(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, fp, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts = free_parts(np.ascontiguousarray(key), np.ascontiguousarray(fp))
        n = parts.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(key, n), parts.ravel(), np.repeat(fp, n), np.repeat(c, n))], names=["key", "part", "fp", "c"])


def _outside(named: DataFrame) -> DataFrame:
    """named (key, fp, c) of those keys that have more than one component, with out, whether the row isn't of its key's largest one, and rest, how many such rows the key has.

    As spread(), with partial sums and no window, and never broadcast.
    """
    sizes = named.groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    ends = largest.select("key", F.col("most.c").alias("main"), (F.col("n") - F.col("most.n")).alias("rest"))
    return named.join(ends.hint("merge"), "key").select("key", "fp", "c", (F.col("c") != F.col("main")).alias("out"), "rest")


def _few(mixed: DataFrame) -> DataFrame:
    """(u, v): components of two members of a key that are close; the few outside its largest component are held against all."""
    out = mixed.where("out").select("key", F.col("fp").alias("fp2"), F.col("c").alias("v"))
    return mixed.withColumnRenamed("c", "u").join(out, "key").where((F.col("u") != F.col("v")) & _close("fp", "fp2")).select("u", "v")


def _many(mixed: DataFrame) -> DataFrame:
    """As _few(), by the parts of the bits that a key leaves free."""
    parts = mixed.select("key", "fp", "c").mapInArrow(_parts, "key long, part long, fp long, c long")
    other = parts.select("key", "part", F.col("fp").alias("fp2"), F.col("c").alias("v"))
    return parts.withColumnRenamed("c", "u").join(other.hint("merge"), ["key", "part"]).where((F.col("u") < F.col("v")) & _close("fp", "fp2")).select("u", "v")


def link_fingerprints(unique: DataFrame) -> DataFrame:
    """(node, root) for fingerprints (fp, without repeats) that link to others at four or fewer differing bits.

    Under each key, all members are first held against its smallest and its largest member, which
    joins large groups in linear work. Only keys whose members are then still in more than one
    component have these compared with each other. Where few members stand outside the key's largest
    component, these are held against all. Else members are compared that also agree in one of five
    parts of the bits that the key leaves free, as any two at four bits do.
    """
    members = unique.select("fp").mapInArrow(_explode, "key long, fp long")
    shared = cut(spread(members, "fp"), "keys")
    star = shared.select("fp", F.explode(F.array("lo", "hi")).alias("u")).where(_close("fp", "u")).select("u", F.col("fp").alias("v"))
    first = components(star)
    named = cut(shared.select("key", "fp").join(first, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("c")), "named")
    drop(shared)
    mixed = cut(_outside(named), "mixed")
    drop(named)
    pairs = _few(mixed.where(F.col("rest") <= FEW)).unionByName(_many(mixed.where(F.col("rest") > FEW))).distinct()
    second = components(pairs)
    drop(mixed)
    roots = first.select("node", "root").unionByName(first.select(F.col("root").alias("node"), "root")).distinct()
    joined = roots.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(roots, "node", "left_anti").select("node", "root")  # had no star
    return joined.unionByName(alone)


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id, first) of each fingerprint of rows (id, tie, row, fp); first is its class's row with the smallest id."""
    unique = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "row")).alias("first")), "unique")
    linked = unique.join(link_fingerprints(unique), F.col("fp") == F.col("node"), "left").select("fp", "least", "first", "root")
    linked = cut(linked.withColumn("root", F.coalesce("root", "fp")).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))), "linked")
    classes = linked.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"), F.min("first").alias("kept"))
    large = classes.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = linked.join(large, ["root", "salt"], "left")
    return found.select("fp", F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("kept", "first").alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest key reachable over links, that of the row's own class included.
    Null and wordless texts have fingerprint zero and link like any other; null keys are ignored
    for component_id, which is null where a class has no other; rows that repeat a key stay apart.
    """
    rows = fingerprints(Packed(docs, id=key, text=text).df.select("id", "text"))
    rows = cut(rows.select("id", F.lit(0).alias("tie"), F.lit(0).alias("row"), F.col("fingerprint").alias("fp")), "fingerprints")
    return rows.join(_classes(rows), "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class with the smallest key, with all its columns.

    Null keys come last; of rows alike in key and text the one with the smallest hash of its other
    columns stays, of rows alike in all columns one.
    """
    packed = Packed(docs, id=key, text=text)
    whole = cut(packed.df.withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = fingerprints(whole.select("id", "row", packed.tie().alias("tie"), "text")).select("id", "tie", "row", F.col("fingerprint").alias("fp"))
    kept = _classes(cut(rows, "fingerprints")).select("kept.row").distinct()
    return packed.unpack(whole.join(kept, "row"))
