"""Quality rules: how far a document's histograms stray from those of a language.

Each language's reference is the histogram of byte classes and of its common words over all
documents of that language that pass the base rules. A language has one only from a number of such
documents and words on, so that neither junk without a language nor a mistyped one is its own
reference. A document is held against its language's reference by Jensen-Shannon distance (the root
of the divergence in bits, 0 to 1), and against all where its language has none, and is rejected if
it is far. Texts below a length are not judged by a histogram that so few words can't fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Packed, add_columns, without
from .store import cut
from .textops import BLANKS, covered, lower, mix, per_text, pieces, separators, window_hashes, word_hashes, words

#: A language's common words make up at least this share of its words each: 1 / COMMON at most.
COMMON = 1 / 300
MIN_WORDS, MAX_REPEATED = 20, 30
#: Guards: a language has a reference from so many passing documents and words on, and from this share of all
#: passing words on, so that a name mistyped now and then has none however large the input is.
REFERENCE_DOCS, REFERENCE_WORDS, REFERENCE_SHARE = 10, 1000, 1 / 200_000
#: So many references at most, those of the languages with most words; other texts are held against all, as those without a language.
LANGUAGES = 2000
#: Guards: a text is judged by classes from so many words on, by common words from so many.
CLASS_WORDS, COMMON_WORDS = 20, 50
#: Largest distance that passes, by byte classes and by common words.
CLASS_DISTANCE, COMMON_DISTANCE = 0.32, 0.45

_BLANK = separators(BLANKS)
_LINE = separators(b"\n")
_SYMBOL = separators(b"#*$%&|<>")
#: Byte classes: small letter, capital, other letter, digit, blank, sentence mark, symbol; bytes that continue a character have none.
_CLASS = np.full(256, 6, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0xC0:], _CLASS[0x30:0x3A] = 0, 1, 2, 3
_CLASS[list(BLANKS)] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[0x80:0xC0] = 7
N_CLASSES = 7


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def _salt(n: np.ndarray) -> np.ndarray:
    """A number for each element's text, so that equal hashes of two texts differ."""
    return np.repeat(mix(np.arange(1, len(n) + 1, dtype=np.uint64)), n)


def repeat_words(hashes: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """Words of each text in windows of eight that it has twice or more."""
    window, whole = window_hashes(hashes, wo, 8)
    marks = np.zeros(len(hashes), bool)
    marks[np.flatnonzero(whole)[_repeated((window ^ _salt(np.diff(wo)))[whole])]] = True
    return per_text(covered(marks, 8).astype(np.int64), wo)


def base_counts(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, wo: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text, whose words are known."""
    doc = np.diff(off)
    char = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~_BLANK[data])])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    s, e, lo = words(data, off, _LINE)
    worded = np.searchsorted(starts, e) > np.searchsorted(starts, s)
    line_keys = word_hashes(data, s, e) ^ _salt(np.diff(lo))
    line_doc = np.repeat(np.arange(len(doc)), np.diff(lo))[worded]
    _, first = np.unique(line_keys[worded], return_index=True)
    dup = np.ones(len(line_doc), bool)
    dup[first] = False
    return {
        "n_words": np.diff(wo), "word_chars": char[off[1:]] - char[off[:-1]], "n_symbols": symbol[off[1:]] - symbol[off[:-1]],
        "n_dup_lines": np.bincount(line_doc[dup], minlength=len(doc)), "n_repeat_words": repeat_words(word_hashes(data, starts, ends), wo),
    }


def base_failed(n_words, n_repeat_words):
    """Of columns or arrays: too few words, or too many in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def common_words(docs: DataFrame, text: str, lang: str, guard: tuple[int, int, float] = (REFERENCE_DOCS, REFERENCE_WORDS, REFERENCE_SHARE)) -> list:
    """Rows (lang, word, n, size): the common words of each language that has a reference, counted over all documents that pass the base rules.

    size is the number of the language's words; at most 1 / COMMON rows a language reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            of = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            code = np.array([of[x] for x in langs], np.int64)
            for i, j, data, off in pieces(batch.column("text")):
                starts, ends, wo = words(data, off, _BLANK)
                passed = ~base_failed(np.diff(wo), repeat_words(word_hashes(data, starts, ends), wo))
                own = code[i:j][passed]
                data = lower(data)
                # Words and the blanks between them in turn, as one array without copies.
                edges = np.append(np.column_stack([starts, ends]).ravel(), len(data)).astype(np.int32)
                both = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
                h, k = word_hashes(data, starts, ends), np.repeat(np.where(passed, code[i:j], -1), np.diff(wo))
                for x, number in of.items():
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()), pa.array([None], pa.string()), pa.array([int((own == number).sum())], pa.int64())], names=["lang", "word", "n"])  # its documents
                    mine = np.flatnonzero(k == number)
                    _, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(n), pa.string()), both.take(pa.array(2 * mine[first])), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word string, n long")
    counts = cut(rows.where("lang is not null").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = counts.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("docs"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    known = sizes.where((F.col("docs") >= guard[0]) & (F.col("size") >= guard[1]) & (F.col("size") >= guard[2] * total)).orderBy(F.desc("size"), "lang").limit(LANGUAGES).select("lang", "size")
    common = counts.where("word is not null").join(F.broadcast(known), "lang").where(F.col("n") >= COMMON * F.col("size"))
    return common.select("lang", "word", "n", "size").collect()


def features(docs: DataFrame, text: str, candidates: list[str]) -> DataFrame:
    """docs with the base figures, classes (count of each byte class) and the counts of candidate words as parallel arrays at, n."""
    data = "".join(candidates).encode()
    ends = np.cumsum([len(x.encode()) for x in candidates]).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    hashes = word_hashes(np.frombuffer(data, np.uint8), starts, ends) if candidates else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], order))

    def measure(batch: pa.RecordBatch) -> list:
        known, index = shared.value
        out: list[list] = [[] for _ in range(8)]
        for i, j, data, off in pieces(batch.column(text)):
            starts, ends, wo = words(data, off, _BLANK)
            counts = base_counts(data, off, starts, ends, wo)
            doc = np.repeat(np.arange(j - i), np.diff(off))
            classes = np.bincount(doc * 8 + _CLASS[data], minlength=(j - i) * 8).reshape(-1, 8)[:, :N_CLASSES]
            h = word_hashes(lower(data), starts, ends)
            doc = np.repeat(np.arange(j - i), np.diff(wo))
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                pair, n = np.unique(doc[hit] * len(known) + index[at[hit]], return_counts=True)
                edges = np.searchsorted(pair, np.arange(j - i + 1) * len(known))
                word = pair % len(known)
            else:
                word, n, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(j - i + 1, np.int64)
            for k, x in enumerate(counts.values()):
                out[k].append(pa.array(x.astype(np.int64)))
            out[5].append(pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * N_CLASSES), pa.array(classes.ravel().astype(np.int32))))
            out[6].append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(word.astype(np.int32))))
            out[7].append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(n.astype(np.int32))))
        return [pa.concat_arrays(x) for x in out]

    return add_columns(docs, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<int>, at array<int>, n array<int>", measure)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between histograms (rows of p) and one histogram q."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1e-12)
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.maximum(a, 1e-300) / np.maximum(m, 1e-300)), 0).sum(-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs (without the text if not keep_text) with the base figures, base_failed, class_distance, common_distance and kept.

    Null texts have no words. Distances are those to the reference of the row's language, or to the
    nearest one where that language is null or has none, and null below the guards; kept is false if
    base_failed or where no reference in question is within all distances that apply. Where no
    language has a reference all that pass the base rules are kept. Columns of docs that have such a
    name are replaced; no other name matters. The references are bounded by 1 / COMMON words a
    language and LANGUAGES languages. A text with a reference of its own is compared with that alone.
    """
    spark = docs.sparkSession
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept"]
    packed = Packed(without(docs, made), lang=lang, text=text)
    common_rows = common_words(packed.df.select("lang", "text"), "text", "lang")
    candidates = sorted({r.word for r in common_rows})
    number = {x: k for k, x in enumerate(candidates)}
    measured = features(packed.df, "text", candidates)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    measured = cut((measured if keep_text else measured.drop("text")).withColumn("base_failed", failed), "features")
    languages = sorted({r.lang for r in common_rows})
    good = measured.where(~failed & F.col("lang").isin(languages)).select("lang", "classes")
    by_class = good.select("lang", F.posexplode("classes").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()
    class_counts, of = {x: np.zeros(N_CLASSES) for x in languages}, {x: [] for x in languages}
    for r in by_class:
        class_counts[r.lang][r.k] = r.n
    for r in common_rows:
        of[r.lang].append((number[r.word], r.n, r.size))
    references = {}
    for x, mine in of.items():
        common = np.array([n for _, n, _ in sorted(mine)] + [mine[0][2] - sum(n for _, n, _ in mine)], float)
        references[x] = class_counts[x], np.array([w for w, _, _ in sorted(mine)], np.int64), common
    shared = spark.sparkContext.broadcast((references, len(candidates)))

    def against(batch: pa.RecordBatch, chosen: list, n_candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row, whether one of the chosen references is near enough, and the distances to the nearest by classes and by words."""
        n = batch.column("n_words").to_numpy()
        classes = batch.column("classes").flatten().to_numpy().reshape(-1, N_CLASSES).astype(float)
        at, count = batch.column("at"), batch.column("n").flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), np.diff(at.offsets.to_numpy()))
        word = at.flatten().to_numpy()
        fine, near, near_common = np.zeros(len(n), bool), np.full(len(n), np.inf), np.full(len(n), np.inf)
        for reference, common, weights in chosen:
            d = distance(classes, reference)
            place = np.full(n_candidates, -1)
            place[common] = np.arange(len(common))
            where = place[word] >= 0
            own = np.bincount(doc[where] * (len(common) + 1) + place[word[where]], count[where], len(n) * (len(common) + 1)).reshape(len(n), -1)
            own[:, -1] = n - own.sum(1)
            dc = distance(own, weights)
            fine |= ((d <= CLASS_DISTANCE) | (n < CLASS_WORDS)) & ((dc <= COMMON_DISTANCE) | (n < COMMON_WORDS))
            near, near_common = np.minimum(near, d), np.minimum(near_common, dc)
        return fine, near, near_common

    def verdict(batch: pa.RecordBatch) -> list:
        references, n_candidates = shared.value
        langs = batch.column("lang").to_pylist()
        rows: dict[str | None, list[int]] = {}
        for i, x in enumerate(langs):
            rows.setdefault(x if x in references else None, []).append(i)
        fine, near, near_common = np.zeros(len(langs), bool), np.full(len(langs), np.inf), np.full(len(langs), np.inf)
        for x, mine in rows.items():
            chosen = list(references.values()) if x is None else [references[x]]
            fine[mine], near[mine], near_common[mine] = against(batch.select(["n_words", "classes", "at", "n"]).take(pa.array(mine)), chosen, n_candidates)
        fine |= not references
        kept = fine & ~np.asarray(batch.column("base_failed"))
        n = batch.column("n_words").to_numpy()
        mask = lambda x, guard: pa.array(x, pa.float64(), mask=(n < guard) | np.isinf(x))
        return [mask(near, CLASS_WORDS), mask(near_common, COMMON_WORDS), kept]

    judged = add_columns(measured, "class_distance double, common_distance double, kept boolean", verdict)
    return packed.unpack(judged, *map(F.col, made), less=None if keep_text else text)
