"""Exact substring deduplication of word windows, anchored at a difference cover.

D = {0, 1, 3, 9} modulo 13 holds, for any two positions i and j, a shift d < 13 with i + d and
j + d both on the cover. Equal windows of 20 words thus share an equal run of 20 - 13 + 1 = 8
words that starts on the cover in both. First only these anchors are hashed and looked up; then
windows are extended from anchors that stand in the corpus more than once, and the whole windows
are looked up to find which of them start earlier elsewhere. Windows are equal where two hashes of
64 bits are, both made of the words' hashes; anchors that collide only make windows be looked up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answer, answers, ask, asked, by_block, to_blocks, with_answers
from .order import numbered
from .rows import Packed, without
from .store import cut
from .textops import BLANKS, covered, mix, per_text, pieces, separators, window_hashes, word_hashes, words

#: A difference cover of 13. Any other pair would do that covers all differences.
PERIOD, COVER = 13, (0, 1, 3, 9)

#: Told from the words' hashes themselves, so that windows have a second hash.
_SECOND = np.uint64(0xD1B54A32D192ED03)
_BLANK = separators(BLANKS)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _hashes(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and its documents' offsets in words."""
    hashes, offsets, base = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, data, off in pieces(table.column(text)):
        starts, ends, wo = words(data, off, _BLANK)
        hashes.append(word_hashes(data, starts, ends))
        offsets.append(base + wo[1:])
        base += wo[-1]
    return np.concatenate(hashes), np.concatenate(offsets)


def _repeats(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First hash of each distinct one (or tuple of several) in order, how often each occurs, and each one's first place."""
    order = np.lexsort(hashes[::-1]) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    at = np.flatnonzero(_new(*(h[order] for h in hashes)))
    return hashes[0][order[at]], np.diff(np.append(at, len(order))), order[at]


def _new(*ordered: np.ndarray) -> np.ndarray:
    """Which places differ from the one before."""
    out = np.ones(len(ordered[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in ordered], axis=0)
    return out


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
    return some[at] == values


def _anchors(hashes: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that start on the cover."""
    run, whole = window_hashes(hashes, off, length)
    place = np.arange(len(hashes)) - np.repeat(off[:-1], np.diff(off))
    at = np.flatnonzero(whole & _ON_COVER[place % PERIOD])
    return at, run[at]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 20) -> DataFrame:
    """docs with n_words, n_removed and kept_text: words covered by an n-word window that also starts earlier are removed.

    Earlier is a smaller key, or an earlier start in the same text. Null texts have no words and
    kept_text null if nothing was there to keep; null keys come first; rows that repeat a key come
    in the order of their rows in the input. Where nothing is removed kept_text is the text itself;
    else the kept words, with the original blanks between words that stay neighbours. Keys that are
    not integers are replaced by their places in Spark's order of them. Columns of docs that have
    such a name are replaced; no other name matters.
    """
    length = n - PERIOD + 1
    packed = Packed(without(docs, ["n_words", "n_removed", "kept_text"]), text=text)
    rows = packed.df.withColumn("id", F.col(f"rest.{packed.place[key]}"))
    if dict(rows.dtypes)["id"] not in ("tinyint", "smallint", "int", "bigint"):
        places = numbered(rows.select("id").where("id is not null").distinct(), "place")
        rows = rows.join(places, "id", "left").drop("id").withColumnRenamed("place", "id")
    blocks, route = to_blocks(rows.select("text", "rest", F.col("id").cast("long").alias("id")), "text", "blocks")
    texts = blocks.select("block", "ord", "id", "text")

    def send_anchors(table: pa.Table) -> pa.Table:
        distinct, count, _ = _repeats(_anchors(*_hashes(table, "text"), length)[1])
        return ask(table.column("block")[0].as_py(), distinct, route, count > 1)

    def shared(hashes: np.ndarray, sender: np.ndarray, often: np.ndarray) -> np.ndarray:
        ordered = np.sort(hashes)
        return _among(hashes, np.unique(ordered[1:][ordered[1:] == ordered[:-1]])) | often

    back = answer(by_block(texts, send_anchors, asked(1)), route, [bool], bool, shared)

    def candidates(table: pa.Table, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the windows that hold a shared anchor, their two hashes, and the documents' offsets."""
        hashes, off = _hashes(table, "text")
        at, run = _anchors(hashes, off, length)
        distinct = np.unique(run)
        at = at[_among(run, distinct[answers(replies, distinct, route, bool)])]
        near = np.zeros(len(hashes) + 1, np.int32)
        doc = np.searchsorted(off, at, "right") - 1
        near[np.maximum(at - PERIOD + 1, off[doc])] += 0  # keeps the dtype where there is no anchor
        np.add.at(near, np.maximum(at - PERIOD + 1, off[doc]), 1)
        np.add.at(near, at + 1, -1)
        window, whole = window_hashes(hashes, off, n)
        place = np.flatnonzero(whole & (np.cumsum(near[:-1]) > 0))
        return place, window[place], window_hashes(mix(hashes ^ _SECOND), off, n)[0][place] if len(place) else window[place], off

    def ranks(table: pa.Table) -> np.ndarray:
        """Each document's place in the order of keys within its block."""
        order = pa.compute.sort_indices(table.select(["id", "ord"]), sort_keys=[("id", "ascending"), ("ord", "ascending")], null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank

    def firsts(table: pa.Table, replies: pa.Table) -> tuple:
        """Candidates with each one's document, and the block's first of each distinct window."""
        place, window, second, off = candidates(table, replies)
        doc = np.searchsorted(off, place, "right") - 1
        order = np.lexsort((place, ranks(table)[doc]))
        place, window, second, doc = place[order], window[order], second[order], doc[order]
        distinct, _, first = _repeats(window, second)
        return place, doc, off, distinct, second[first], first

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, doc, _, distinct, second, first = firsts(table, replies)
        ids = table.column("id")
        known = np.asarray(pa.compute.is_valid(ids))
        ids = np.asarray(pa.compute.fill_null(ids, 0)).astype(np.int64)
        return ask(table.column("block")[0].as_py() if table.num_rows else 0, distinct, route, second, ids[doc[first]], known[doc[first]])

    def later(hashes: np.ndarray, sender: np.ndarray, second: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        order = np.lexsort((sender, ids, known, second, hashes))
        out = np.zeros(len(hashes), bool)
        out[order] = ~_new(hashes[order], second[order])
        return out

    marked = cut(back, "anchors")
    windows_back = answer(with_answers(texts, marked, send_windows, asked(3)), route, [np.uint64, np.int64, bool], bool, later)
    both = marked.withColumn("kind", F.lit(0)).unionByName(windows_back.withColumn("kind", F.lit(1)))

    schema = T.StructType([blocks.schema["text"], blocks.schema["rest"], *T._parse_datatype_string("n_words bigint, n_removed bigint, kept_text string").fields])

    def rest(table: pa.Table, replies: pa.Table) -> pa.Table:
        one = replies.filter(pa.compute.equal(replies.column("kind"), 0))
        place, doc, off, distinct, _, first = firsts(table, one)
        window_later = answers(replies.filter(pa.compute.equal(replies.column("kind"), 1)), distinct, route, bool)
        starts = np.ones(len(place), bool)
        starts[first] = window_later
        marks = np.zeros(off[-1], bool)
        marks[place[starts]] = True
        gone = covered(marks, n)
        removed = per_text(gone, off)
        kept = table.column("text").to_pylist()
        for i in np.flatnonzero(removed):
            kept[i] = without_words(kept[i], gone[off[i] : off[i + 1]])
        return table.select(["text", "rest"]).append_column("n_words", pa.array(np.diff(off))).append_column("n_removed", pa.array(removed.astype(np.int64))).append_column("kept_text", pa.array(kept, pa.string()))

    return packed.unpack(with_answers(blocks, both, rest, schema), *map(F.col, ("n_words", "n_removed", "kept_text")))


def without_words(text: str, gone: np.ndarray) -> str:
    """text less these words; a run of removed words takes the blanks before it along."""
    data = text.encode()
    starts, ends, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _BLANK)
    keep = ~gone
    out, last = [], False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if last:
            out.append(data[ends[a - 1] : starts[a]] or b" ")
        out.append(data[starts[a] : ends[b - 1]])
        last = True
    return b"".join(out).decode()


def kept_digest(column: pa.Array) -> list[str]:
    """SHA-256 of each text's words, joined by one space."""
    return [hashlib.sha256(b" ".join(x.encode().split()) if x else b"").hexdigest() for x in column.to_pylist()]
