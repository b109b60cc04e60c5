"""Benchmark decontamination: one Aho-Corasick automaton over normalised word windows of the test items.

Windows are made and made distinct in Spark. Each worker builds the automaton of all of them; only
where there are more than AUTOMATON_WINDOWS are they dealt over several automata, each with a scan
of its own, so that a worker's memory doesn't grow with the benchmark. Such a scan reads the texts
and gives the places hit, which are few, and no copy of the documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Packed, add_columns, without
from .store import cut
from .textops import LOWER, NON_WORD, pieces

#: Windows that one automaton holds, on average.
AUTOMATON_WINDOWS = 50_000

_PLAIN = bytes(0x20 if i in NON_WORD and not 0x41 <= i <= 0x5A else LOWER[i] for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[int, ahocorasick.Automaton] = {}


def normalised(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


def windows(items: DataFrame, n: int) -> DataFrame:
    """(pattern, size, items) of all distinct windows of n words of items (id, text); a shorter item is one window.

    A pattern is the window's words with a blank around each, as UTF-8 bytes written as Latin-1.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = [x.decode("latin-1") for x in normalised(text)]
                if w:
                    made = [" " + " ".join(w[i : i + n]) + " " for i in range(max(1, len(w) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(made), pa.array([min(n, len(w))] * len(made), pa.int32()), pa.array([item] * len(made), pa.string())], names=["pattern", "size", "item"])

    made = items.mapInArrow(cut_up, "pattern string, size int, item string")
    return made.groupBy("pattern").agg(F.first("size").alias("size"), F.array_sort(F.collect_set("item")).alias("items"))


def _automaton(shared) -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    if shared.value[0] not in _built:
        _built.clear()
        a = ahocorasick.Automaton()
        for pattern, size, of in shared.value[1]:
            a.add_word(pattern, (size, of))
        if len(a):
            a.make_automaton()
        _built[shared.value[0]] = a
    return _built[shared.value[0]]


def _scan(texts: pa.Array, automaton: ahocorasick.Automaton) -> tuple[list[int], list[list[dict]]]:
    """Words of each text, and its hits (first word, end word, items)."""
    counts: list[int] = []
    hits: list[list[dict]] = [[] for _ in range(len(texts))]
    for first, stop, _, _ in pieces(texts):
        parts, at, size = [], [], 0
        for t in texts.slice(first, stop - first).to_pylist():
            w = normalised(t)
            counts.append(len(w))
            parts.append(b" " + b" ".join(w) + b" \n")
            at.append(size)
            size += len(parts[-1])
        if not len(automaton):
            continue
        whole = b"".join(parts)
        found = list(automaton.iter(whole.decode("latin-1")))
        if found:
            end = np.array([x[0] for x in found])
            text = np.searchsorted(at, end, "right") - 1
            blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 0x20)
            last = np.searchsorted(blanks, end) - np.searchsorted(blanks, np.array(at)[text])  # words up to the closing blank
            for k, e, (_, (words, of)) in zip(text.tolist(), last.tolist(), found, strict=True):
                hits[first + k].append({"s": e - words, "e": e, "items": of})
    return counts, hits


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """docs with n_words, n_hit (words within a benchmark window), items (sorted strings) and spans.

    spans are the hit passages as character offsets in the original text. Null and wordless texts
    have no words; items without words have no windows; an item without an id marks words but is
    not listed; repeated rows and items count as one. Columns of docs that have such a name are
    replaced; no other name matters. One window's list of items is held whole.
    """
    spark = docs.sparkSession
    packed = Packed(without(docs, ["n_words", "n_hit", "items", "spans"]), text=text)
    patterns = cut(windows(benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")), n), "windows")
    blocks = -(-patterns.count() // AUTOMATON_WINDOWS) or 1

    def automaton_of(block: int):  # noqa: ANN202
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part]))

    found = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    if blocks == 1:
        shared = automaton_of(0)
        out = add_columns(packed.df, found, lambda b: _digest(*_scan(b.column("text"), _automaton(shared)), b.column("text")))
        return packed.unpack(out, *map(F.col, ("n_words", "n_hit", "items", "spans")))

    rows = cut(packed.df.withColumn("at", F.monotonically_increasing_id()), "texts")

    def hits_of(block: int) -> DataFrame:
        shared = automaton_of(block)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = _scan(batch.column("text"), _automaton(shared))[1]
                some = [i for i, x in enumerate(hits) if x]
                if some:
                    yield pa.RecordBatch.from_arrays([batch.column("at").take(pa.array(some)), pa.array([hits[i] for i in some], places)], names=["at", "hits"])

        return cut(rows.select("at", "text").mapInArrow(scan, "at long, hits array<struct<s:int,e:int,items:array<string>>>"), "hits")

    places = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("items", pa.list_(pa.string()))]))
    hits = reduce(DataFrame.unionAll, [hits_of(block) for block in range(blocks)])
    joined = rows.join(hits.groupBy("at").agg(F.flatten(F.collect_list("hits")).alias("hits")), "at", "left")

    def digest(batch: pa.RecordBatch) -> list:
        return _digest([len(normalised(t)) for t in batch.column("text").to_pylist()], [x or [] for x in batch.column("hits").to_pylist()], batch.column("text"))

    out = add_columns(joined, found, digest)
    return packed.unpack(out, *map(F.col, ("n_words", "n_hit", "items", "spans")))


def _digest(counts: list, hits: list, column: pa.Array) -> list:
    n_hit, items, spans = [], [], []
    for k, found in enumerate(hits):
        runs: list[list[int]] = []
        for s, e in sorted({(h["s"], h["e"]) for h in found}):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        n_hit.append(sum(e - s for s, e in runs))
        items.append(sorted({x for h in found for x in h["items"]}))
        where = [m.span() for m in _WORD.finditer(column[k].as_py())] if found else []
        spans.append([{"start": where[s][0], "end": where[e - 1][1]} for s, e in runs])
    return [counts, n_hit, items, spans]
