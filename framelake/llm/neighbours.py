"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, its character grams of three bytes, and these grams with letters and
digits by kind, each family hashed to as many numbers. Their counts, weighted and reduced to the
leading directions of the labelled texts, are its latent vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Packed, add_columns, without
from .textops import BLANKS, lower, pieces, separators, word_hashes, words

#: Bounds of what is fitted on: labelled texts, of those with the smallest hashes, and sizes of the model. TERMS are those of one family.
SAMPLE, TERMS, LATENT, NEIGHBOURS = 4096, 4096, 64, 25
FAMILIES = 3
#: Similarities count to this power.
SHARPNESS = 8
#: Texts are counted so many at a time, which bounds the matrix of counts whatever their lengths.
BATCH = 128

_BLANK = separators(BLANKS)
#: Kinds of bytes: small letters, capitals and digits, letters beyond ASCII, blanks; other characters as they are.
_KIND = np.arange(256, dtype=np.uint32)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0x20


def _grams(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below TERMS for each three bytes in a row; zeros stand behind a text's end."""
    one, two = np.zeros(len(x), np.uint32), np.zeros(len(x), np.uint32)
    one[:-1], two[:-2] = x[1:], x[2:]
    one[ends[ends > 0] - 1] = 0
    two[ends[ends > 0] - 1] = 0
    two[ends[ends > 1] - 2] = 0
    mixed = ((x.astype(np.uint32) * np.uint32(65599) + one) * np.uint32(65599) + two) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(20)) % np.uint32(TERMS)


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, FAMILIES * TERMS): counts of hashed words, grams and shapes in each text."""
    n, low = len(off) - 1, lower(data)
    starts, ends, wo = words(low, off, _BLANK)
    by_byte, by_word = (np.repeat(np.arange(n), np.diff(o)) * (FAMILIES * TERMS) for o in (off, wo))
    hashed = (word_hashes(low, starts, ends) >> np.uint64(40)).astype(np.int64) % TERMS
    at = np.concatenate([by_word + hashed, by_byte + TERMS + _grams(low, off[1:]), by_byte + 2 * TERMS + _grams(_KIND[data], off[1:])])
    return np.bincount(at, minlength=n * FAMILIES * TERMS).reshape(n, -1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts by logarithm and idf, each family of length one."""
    x = (np.log1p(counts.astype(np.float32)) * idf).reshape(len(counts), FAMILIES, TERMS)
    return (x / np.maximum(np.linalg.norm(x, axis=2, keepdims=True), 1e-9)).reshape(counts.shape)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j, data, off in pieces(column):
        for a in range(0, j - i, BATCH):
            o = off[a : a + BATCH + 1]
            yield data[o[0] : o[-1]], o - o[0]


def vectors(column: pa.Array, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of texts, of length one."""
    parts = [_unit(weighted(term_counts(data, off), idf) @ basis) for data, off in _batches(column)]
    return np.concatenate([np.zeros((0, basis.shape[1]), np.float32), *parts])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, seed: int = 7) -> tuple:
    """(idf, basis, vectors, labels) from at most `sample` labelled texts, the same ones in each run.

    Of a key's repeated labels the smallest counts, of its texts the one with the smallest hash, so a
    key is one of the sample however often it stands in either table. Null labels, keys and texts
    of labels teach nothing, empty texts are texts.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")  # at most `sample` rows
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def counts(b: pa.RecordBatch) -> list:
        terms, numbers = [], []
        for data, off in _batches(b.column("text")):
            for x in term_counts(data, off):
                at = np.flatnonzero(x)
                terms.append(at.astype(np.int32))
                numbers.append(x[at].astype(np.float32))
        return [pa.array(terms, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.float32()))]

    found = add_columns(rows, "terms array<int>, numbers array<float>", counts).select("id", "label", "terms", "numbers").toPandas().sort_values("id")
    x, often = np.zeros((len(found), FAMILIES * TERMS), np.float32), np.zeros(FAMILIES * TERMS)
    for i, (t, n) in enumerate(zip(found["terms"], found["numbers"], strict=True)):
        x[i, np.asarray(t, np.int64)] = n
        often[t] += 1
    labels_of = found["label"].to_numpy(np.float32)
    del found
    idf = np.log((1 + len(x)) / (1 + often)).astype(np.float32) + 1
    for i in range(0, len(x), BATCH):  # in place: the matrix is the driver's largest piece, 200 MB for 4096 texts
        x[i : i + BATCH] = weighted(x[i : i + BATCH], idf)
    q = np.random.default_rng(seed).standard_normal((FAMILIES * TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :LATENT].astype(np.float32)
    return idf, basis, _unit(x @ basis).astype(np.float32), labels_of


def share_of_ones(z: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the NEIGHBOURS nearest of the known vectors, by exact cosine in blocks.

    All that are as near as the last of these count. Where none is alike it is the share of all labels.
    """
    score, k = np.full(len(z), float(labels.mean()) if len(labels) else 0.5), min(NEIGHBOURS, len(known))
    for i in range(0, len(z) if k else 0, 512):
        near = z[i : i + 512] @ known.T
        last = np.partition(near, len(known) - k, axis=1)[:, [len(known) - k]]
        weight = np.where(near >= last, np.maximum(near, 0), 0).astype(float) ** SHARPNESS
        total = weight.sum(1)
        score[i : i + 512] = np.where(total > 0, weight @ labels / np.maximum(total, 1e-300), score[i : i + 512])
    return np.clip(score, 0, 1)


def vote(docs: DataFrame, model: tuple, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted.

    score is the similarity-weighted share of label 1 among the nearest labelled vectors. Null, empty
    and unlike texts get the share of label 1 among all labels; without any label that is 0.5.
    Columns of docs that have such a name are replaced; no other name matters.
    """
    packed = Packed(without(docs, ["score", "predicted"]), text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> list:
        idf, basis, known, labels = shared.value
        score = share_of_ones(vectors(batch.column("text"), idf, basis), known, labels)
        return [score, (score >= threshold).astype(np.int32)]

    return packed.unpack(add_columns(packed.df, "score double, predicted int", predict), F.col("score"), F.col("predicted"))
