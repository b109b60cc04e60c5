"""Language identification of spans: script ranges narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Packed, add_columns, without
from .textops import PIECE_BYTES, lower, pieces, runs

GRAMS = 1 << 16
#: So many languages are learned at most, those with most bytes of text; a model has GRAMS numbers for each, some 130 MB in all.
LANGUAGES = 500
#: A task holds the counts of so many languages at a time.
_HELD = 100
#: Natural log-odds that a change of language between two words has to make up for.
SWITCH = 12.0
#: A language is a candidate for a script that at least this share of its letters is written in.
SCRIPT_SHARE = 0.001
#: Words that Viterbi goes through one after the other; longer texts are cut into such runs, which are worked on side by side.
SEGMENT = 512

#: Scripts by ranges of code points, both ends included.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Besides scripts: no letter (0), a letter of another script, and a mark that belongs to the letter before it.
OTHER, MARK = len(SCRIPTS) + 1, len(SCRIPTS) + 2
N_SCRIPTS = len(SCRIPTS) + 2


@cache
def script_table() -> np.ndarray:
    """By code point: a letter's script, MARK, or 0; no letter stands beyond the table's end."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x32400)]
    table = np.array([OTHER if k == "L" else MARK if k == "M" else 0 for k in kinds], np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part == OTHER] = number
    return table


def scripts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, and its entry in script_table()."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    x = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    point = x[at]
    for least, most, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((point >= least) & (point < most) & (x[at] == point))
        value = point[some] & mask
        for k in range(1, more + 1):
            value = value << 6 | x[at[some] + k] & 0x3F
        point[some] = value
    table = script_table()
    return at, np.where(point < len(table), table[np.minimum(point, len(table) - 1)], 0)


def grams(data: np.ndarray, inside: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed three-byte grams, one for each byte; what is no letter, and what is beyond a text's ends, counts as a blank."""
    x = np.where(inside, data, np.uint8(32)).astype(np.uint32)
    before, after = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    before[1:], after[:-1] = x[:-1], x[1:]
    edges = off[(off > 0) & (off < len(x))]
    before[edges], after[edges - 1] = 32, 32
    return ((before * np.uint32(0x9E3779B1) ^ x * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, its byte where this begins, bytes, offsets, whether the text ends here) as pieces() has them; a long text comes in several chunks, cut at blanks."""
    for i, _, data, off in pieces(column):
        whole = data.tobytes() if len(data) > 2 * PIECE_BYTES else b""
        begin = 0
        while len(whole) - begin > 2 * PIECE_BYTES:
            cut = whole.rfind(b" ", begin + PIECE_BYTES // 2, begin + PIECE_BYTES)
            if cut < 0:
                break  # no blank in a megabyte
            yield i, begin, data[begin:cut], np.array([0, cut - begin]), False
            begin = cut
        yield i, begin, data[begin:], off if not begin else np.array([0, len(data) - begin]), True


def train(docs: DataFrame, chosen: F.Column, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all chosen rows of the languages learned; grams from GRAMS on stand for scripts.

    Of languages with equally many bytes the first by name are learned.
    """

    def rows_of(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for x, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            index = {x: i for i, x in enumerate(sorted(set(names)))}
            for i, _, data, off, _ in chunks(batch.column("text")):
                at, script = scripts_of(data)
                inside = np.repeat(script > 0, np.diff(np.append(at, len(data))))
                data = lower(data)
                of = np.repeat([index[x] for x in names[i : i + len(off) - 1]], np.diff(off))
                found = np.bincount((of * GRAMS + grams(data, inside, off))[inside], minlength=len(index) * GRAMS).reshape(-1, GRAMS)
                letter = (script > 0) & (script != MARK)
                scripts = np.bincount(of[at[letter]] * N_SCRIPTS + script[letter], minlength=len(index) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
                for x, k in index.items():
                    totals[x] = totals.get(x, 0) + np.concatenate([found[k], scripts[k]])
            if len(totals) > _HELD:
                yield from rows_of(totals)
                totals = {}
        yield from rows_of(totals)

    rows = docs.where(chosen & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size"))
    learned = [r.lang for r in sizes.orderBy(F.desc("size"), "lang").limit(LANGUAGES).collect()]
    rows = rows.where(F.col("lang").isin(learned))
    return rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities of grams (GRAMS, languages), and which languages use a script: at most GRAMS numbers a language."""
    of = counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n"))  # at most as many of each as there are grams
    langs, columns, scripts = [], [], []
    for r in of.orderBy("lang").toLocalIterator():
        n = np.zeros(GRAMS + N_SCRIPTS)
        n[r.gram] = r.n
        langs.append(r.lang)
        columns.append(np.log((n[:GRAMS] + 0.1) / (n[:GRAMS].sum() + 0.1 * GRAMS)).astype(np.float32))
        scripts.append(n[GRAMS:])
    logs = np.stack(columns, 1) if langs else np.zeros((GRAMS, 0), np.float32)
    scripts = np.stack(scripts, 1) if langs else np.zeros((N_SCRIPTS, 0))
    return langs, logs, (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)) & (scripts > 0)


def word_scripts(starts: np.ndarray, at: np.ndarray, script: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Script that most of each word's letters have, of equals the first, and its number of letters; marks don't count."""
    letter = np.flatnonzero((script > 0) & (script != MARK))
    word, kind = np.searchsorted(starts, at[letter], "right") - 1, script[letter].astype(np.int64)
    n = np.bincount(word, minlength=len(starts))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    out = np.zeros(len(starts), np.int64)
    if len(word):
        low, high = np.minimum.reduceat(kind, first), np.maximum.reduceat(kind, first)
        out[word[first]] = low
        mixed = np.zeros(len(starts), bool)
        mixed[word[first[low != high]]] = True
        some = np.flatnonzero(mixed)
        chosen = mixed[word]
        if len(some):
            table = np.bincount(np.searchsorted(some, word[chosen]) * N_SCRIPTS + kind[chosen], minlength=len(some) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
            out[some] = table.argmax(1)
    return out, n


def score_words(data: np.ndarray, off: np.ndarray, logs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text offsets, log-likelihoods (word, language) and letters of the words of texts.

    Words are runs of letters and their marks. Languages that don't use a word's script get little.
    """
    at, script = scripts_of(data)
    inside = np.repeat(script > 0, np.diff(np.append(at, len(data))))
    starts, ends, wo = runs(inside, off)
    gram = grams(lower(data), inside, off)
    out = np.empty((len(starts), logs.shape[1]), np.float32)
    bounds = np.stack([starts, ends], 1).ravel()
    if len(bounds) and bounds[-1] == len(data):
        bounds = bounds[:-1]
    for k in range(logs.shape[1] if len(starts) else 0):
        out[:, k] = np.add.reduceat(logs[:, k][gram], bounds)[::2]
    kind, letters = word_scripts(starts, at, script)
    known = allowed[kind]
    return starts, ends, wo, np.where(known | ~known.any(1, keepdims=True), out, out - 100).astype(np.float32), letters


def _steps(n: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Runs by length, the longest first, and how many of them have a t-th word, for each t and one more."""
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    return order, [int(x) for x in np.searchsorted(-n[order], -np.arange(longest), "left")] + [0]


def _transfers(scores: np.ndarray, start: np.ndarray, n: np.ndarray, switch: float) -> np.ndarray:
    """(runs, languages, languages): best sum of each run that ends in one language, by the language of the word before it."""
    order, active = _steps(n)
    k = scores.shape[1]
    out = np.zeros((len(n), k, k))
    state = np.broadcast_to(np.where(np.eye(k, dtype=bool), 0.0, -switch), (len(n), k, k)) + scores[start[order], None, :]
    for t in range(1, len(active)):
        m = active[t]
        out[order[m : len(state)]] = state[m:]
        state = state[:m]
        if m:
            state = np.maximum(state, state.max(2, keepdims=True) - switch) + scores[start[order[:m]] + t, None, :]
    return out


def _label_runs(scores: np.ndarray, start: np.ndarray, n: np.ndarray, enter: np.ndarray, end: np.ndarray, switch: float, out: np.ndarray) -> None:
    """Most likely languages of each run's words, given what the first word's languages cost and, unless it is -1, the last one's language."""
    order, active = _steps(n)
    start, enter, end = start[order], enter[order], end[order]
    switched, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    state = enter + scores[start]
    last = np.zeros(len(n), np.int64)
    for t in range(1, len(active)):
        m = active[t]
        last[m : len(state)] = np.where(end[m : len(state)] < 0, state[m:].argmax(1), end[m : len(state)])
        state = state[:m]
        if m:
            at = start[:m] + t
            best_before[at] = state.argmax(1)
            floor = state.max(1, keepdims=True) - switch
            switched[at] = state < floor
            state = np.maximum(state, floor) + scores[at]
    now = np.zeros(len(n), np.int64)
    for t in range(len(active) - 2, -1, -1):
        m, more = active[t], active[t + 1]
        now[more:m] = last[more:m]
        at = start[:m] + t
        out[at] = now[:m]
        now[:m] = np.where(switched[at, now[:m]], best_before[at], now[:m])


def label_words(scores: np.ndarray, off: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Most likely language of each word, text by text, of equals the first.

    Texts of more than SEGMENT words are cut into runs. What each run adds between any two languages
    at its ends is worked out for all runs at once; a pass over a text's runs then fixes the
    languages at their ends, and the runs are labelled at once. So a piece takes some SEGMENT steps
    and one for each run of its longest text.
    """
    n = np.diff(off)
    parts = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), parts)
    begin = np.cumsum(parts) - parts
    place = np.arange(len(doc)) - begin[doc]
    start, length = off[:-1][doc] + place * SEGMENT, np.minimum(SEGMENT, n[doc] - place * SEGMENT)
    k, out = scores.shape[1], np.zeros(len(scores), np.int64)
    enter, end = np.zeros((len(doc), k)), np.full(len(doc), -1)
    long = np.flatnonzero(parts > 1)
    if len(long):
        some = np.flatnonzero((parts > 1)[doc])
        move = np.zeros((len(doc), k, k), np.float64)
        move[some] = _transfers(scores, start[some], length[some], switch)
        came = np.zeros((len(doc), k), np.int64)
        best = move[begin[long]].max(1)
        for s in range(1, int(parts.max())):
            more = np.flatnonzero(parts[long] > s)
            sums = (best[more] - best[more].max(1, keepdims=True))[:, :, None] + move[begin[long[more]] + s]
            came[begin[long[more]] + s], best[more] = sums.argmax(1), sums.max(1)
        now = best.argmax(1)
        for s in range(int(parts.max()) - 1, -1, -1):
            more = np.flatnonzero(parts[long] > s)
            run = begin[long[more]] + s
            end[run] = now[more]
            if s:
                now[more] = came[run, now[more]]
                enter[run] = np.where(np.arange(k) == now[more, None], 0.0, -switch)
    if len(doc):
        _label_runs(scores, start, length, enter, end, switch, out)
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans (language, first and end byte in UTF-8 of each run of words).

    lang_pred has the most letters of the text, of equals the first by name; score is its share of
    them. A text that is null or has no letter is 'und' with score 0, as is every text where no
    language was learned. A word's script is that of most of its letters; digits and punctuation are
    no letters. Columns of docs that have such a name are replaced; no other name matters.
    """
    packed = Packed(without(docs, ["lang_pred", "score", "spans"]), text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch: pa.RecordBatch) -> list:
        langs, logs, allowed = shared.value
        texts = batch.column("text")
        n = len(texts)
        pred, score, spans = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
        held: list[tuple] = []
        for first, begin, data, off, done in chunks(texts) if langs else ():
            starts, ends, wo, scores, letters = score_words(data, off, logs, allowed)
            rows = np.repeat(first + np.arange(len(wo) - 1), np.diff(wo))
            shift = begin - np.repeat(off[:-1], np.diff(wo))
            held.append((rows, starts + shift, ends + shift, scores, letters))
            if not done:
                continue
            rows, starts, ends, scores, letters = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            if not len(rows):
                continue
            base = int(rows[0])
            at = np.searchsorted(rows, np.arange(base, int(rows[-1]) + 2))
            label = label_words(scores, at)
            share = np.bincount((rows - base) * len(langs) + label, letters, (len(at) - 1) * len(langs)).reshape(-1, len(langs))
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (rows[1:] != rows[:-1])
            edges = np.flatnonzero(new)
            stops = np.append(edges[1:], len(label))
            best, total = share.argmax(1), share.sum(1)
            for i in np.flatnonzero(total > 0).tolist():
                pred[base + i], score[base + i] = langs[best[i]], float(share[i, best[i]] / total[i])
            for a, b, row in zip(edges.tolist(), stops.tolist(), rows[edges].tolist(), strict=True):
                if total[row - base] > 0:
                    spans[row].append({"lang": langs[label[a]], "start": int(starts[a]), "end": int(ends[b - 1])})
        return [pred, score, spans]

    out = add_columns(packed.df, "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>", predict)
    return packed.unpack(out, *map(F.col, ("lang_pred", "score", "spans")))
