"""Brown class-based n-gram scoring.

Exchange clustering gives every word of the training part a class. The most frequent words are
exchanged on the driver by their bigrams; every other word is then placed by the same gain, the
rise of the class-bigram likelihood, from counts of the classes that stand to its left and right.
Placing is repeated with all words' classes known. A text's probability is the product of class
transitions and of word emissions within classes. Words and their counts are never gathered in one
place: blocks of documents ask hash buckets for the counts and classes of their own words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import Route, answer, answers, ask, asked, sizes
from .store import cut, cut_bucketed, text_bytes
from .textops import BLANKS, lower, per_text, pieces, separators, word_hashes, words

#: Words that are exchanged on the driver, the most frequent ones; classes; sweeps there, and rounds of placing all others.
FREQUENT, CLASSES, SWEEPS, ROUNDS = 1000, 64, 8, 2
#: What is taken off each known word's count for the words of its class that training hasn't seen.
DISCOUNT = 0.5

_BLANK = separators(BLANKS)
#: Marks of tokens: the end of a text; no class, as words that training hasn't seen.
END, UNKNOWN = CLASSES, CLASSES + 1


def _gain(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def cluster(pairs: np.ndarray, counts: np.ndarray, n_words: int, n_fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol by exchange clustering; pairs (n, 2) of symbols and their counts.

    Symbols from n_words on keep a class each of their own, after the others' classes. A word moves
    to the class that most raises the class-bigram likelihood, of equals the first, until a sweep
    moves none.
    """
    n, total = n_words + n_fixed, classes + n_fixed
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(n_fixed)])
    table = np.zeros((total, total))
    np.add.at(table, (of[pairs[:, 0]], of[pairs[:, 1]]), counts)
    same = np.zeros(n)
    own = pairs[:, 0] == pairs[:, 1]
    same[pairs[own, 0]] = counts[own]
    right, left = np.argsort(pairs[:, 0], kind="stable"), np.argsort(pairs[:, 1], kind="stable")
    r_at, l_at = (np.searchsorted(pairs[o, k], np.arange(n + 1)) for o, k in ((right, 0), (left, 1)))
    f = _gain
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            o, i = right[r_at[w] : r_at[w + 1]], left[l_at[w] : l_at[w + 1]]
            o, i = o[pairs[o, 1] != w], i[pairs[i, 0] != w]
            out = np.bincount(of[pairs[o, 1]], counts[o], total)
            into = np.bincount(of[pairs[i, 0]], counts[i], total)
            k = of[w]
            table[k] -= out
            table[:, k] -= into
            table[k, k] -= same[w]
            rows, columns = table[:classes], table[:, :classes].T
            gain = (f(rows + out) - f(rows)).sum(1) + (f(columns + into) - f(columns)).sum(1)
            d = np.arange(classes)
            cell = table[d, d]
            gain += f(cell + out[d] + into[d] + same[w]) - f(cell) - (f(cell + out[d]) - f(cell)) - (f(cell + into[d]) - f(cell))
            sums = table.sum(1)[d], table.sum(0)[d]
            gain -= f(sums[0] + out.sum() + same[w]) - f(sums[0]) + f(sums[1] + into.sum() + same[w]) - f(sums[1])
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = int(k)
            moved += best != k
            of[w] = best
            table[best] += out
            table[:, best] += into
            table[best, best] += same[w]
        if not moved:
            break
    return of


def place(word: np.ndarray, code: np.ndarray, n: np.ndarray, n_words: int, table: np.ndarray) -> np.ndarray:
    """Class of each of n_words words that most raises the class-bigram likelihood of the table, of equals the first.

    A word's counts come as (word, code, n), ascending by word: code is the class of a neighbour to
    the right, or 128 and that of one to the left. The table (classes and the end, both ways) is
    held fixed.
    """
    out = np.zeros(n_words, np.uint8)
    cells = np.vstack([np.pad(table.T[:, :CLASSES], ((0, 128 - len(table)), (0, 0))), table[:, :CLASSES]])  # by code and class
    base, row, column = _gain(cells), table.sum(1)[:CLASSES], table.sum(0)[:CLASSES]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    edges = np.append(first, len(word))
    at = 0
    while at < len(first):  # whole words, about 100,000 counts at a time
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + 100_000, "right")) - 1)
        a, b = edges[at], edges[stop]
        c, x, start = code[a:b], n[a:b].astype(float), first[at:stop] - a
        gain = np.add.reduceat(_gain(cells[c] + x[:, None]) - base[c], start, axis=0)
        right = np.add.reduceat(np.where(c < 128, x, 0), start)[:, None]
        left = np.add.reduceat(np.where(c < 128, 0, x), start)[:, None]
        gain -= _gain(row + right) - _gain(row) + _gain(column + left) - _gain(column)
        out[word[first[at:stop]]] = gain.argmax(1)
        at = stop
    return out


def model_of(table: np.ndarray, n_class: np.ndarray, v_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(moves, unseen): probabilities of the next class (or end) after a class, an end or an unknown word, and of an unknown word in each class.

    Moves are smoothed by the classes' overall shares; after an unknown word these shares hold. A
    known word of class k has (n - DISCOUNT) / n_class[k], so that all probabilities after any
    token sum to one.
    """
    size = CLASSES + 1
    share = (table.sum(0) + 1) / (table.sum() + size)
    moves = np.vstack([(table + size * share) / (table.sum(1, keepdims=True) + size), share])
    unseen = np.append(np.where(n_class > 0, DISCOUNT * v_class / np.maximum(n_class, 1), 1.0), 0.0)
    return moves, unseen


class _Block:
    """A block of documents as its distinct words' hashes, ascending, and each word's place among these."""

    def __init__(self, row: dict) -> None:
        self.block, self.ids = row["block"], row["ids"]
        self.words, self.local, self.off = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["local"], np.uint32), np.frombuffer(row["off"], np.int64)
        self.train = np.frombuffer(row["train"], bool)

    def of_words(self, per_text_: np.ndarray) -> np.ndarray:
        return np.repeat(per_text_, np.diff(self.off))

    def sequence(self, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' values with an end after each text, what stands before each (before a text an end), and which are training."""
        seq = np.insert(values[self.local].astype(np.int64), self.off[1:], end)
        return seq, np.concatenate([[end], seq[:-1]]), np.repeat(self.train, np.diff(self.off) + 1)


def word_blocks(docs: DataFrame) -> tuple[DataFrame, Route]:
    """Blocks of docs (id, text, train), a row each, in a table that is bucketed by block; and the route of its hashes."""
    block_bytes, route, buckets = sizes(docs.sparkSession, text_bytes(docs, "text"))
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *[T.StructField(x, T.BinaryType()) for x in ("words", "local", "off", "train")]])
    arrow = to_arrow_schema(schema)

    def row(block: int, held: list) -> pa.RecordBatch:
        distinct, local = np.unique(np.concatenate([h for _, _, h, _ in held]), return_inverse=True)
        off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, _, _, o in held]))])
        ids = pa.concat_arrays([i for i, _, _, _ in held])
        columns = [[block], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), [distinct.tobytes()], [local.astype(np.uint32).tobytes()], [off.astype(np.int64).tobytes()], [np.concatenate([t for _, t, _, _ in held]).tobytes()]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            train = np.asarray(batch.column("train"))
            for i, j, data, off in pieces(batch.column("text")):
                data = lower(data)
                starts, ends, wo = words(data, off, _BLANK)
                held.append((batch.column("id").slice(i, j - i), train[i:j], word_hashes(data, starts, ends), wo))
                size += len(data) + 100 * (j - i)
                if size >= block_bytes:
                    yield row(block, held)
                    block, held, size = block + 1, [], 0
        if held:
            yield row(block, held)

    return cut_bucketed(docs.mapInArrow(index, schema), "words", "block", buckets), route


def score_texts(docs: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs.

    Learns from rows where train holds (null counts as true). Tokens are the lower-cased words and an
    end; null and wordless texts have the end alone. base_score is the add-one unigram log10
    probability, score that of the class model, in which all unknown words are one. Without training
    rows nothing is known: every token's base probability is one. Repeated rows count each.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    blocks, route = word_blocks(rows)
    broadcast = docs.sparkSession.sparkContext.broadcast

    def alone(function: Callable[[_Block], pa.Table], schema: str) -> DataFrame:
        """function of each block."""
        arrow = to_arrow_schema(T._parse_datatype_string(schema))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from function(_Block(batch.slice(i, 1).to_pylist()[0])).cast(arrow).to_batches()

        return blocks.mapInArrow(run, schema)

    def answered(back: DataFrame, function: Callable[[_Block, pa.Table], pa.Table], schema: str) -> DataFrame:
        """function of each block and of what came back to it."""
        arrow = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
        replies = back.where("sender is not null").withColumnRenamed("sender", "block").groupBy("block")
        return blocks.groupBy("block").cogroup(replies).applyInArrow(lambda left, right: function(_Block(left.to_pylist()[0]), right).cast(arrow), schema)

    def count(b: _Block) -> pa.Table:
        return ask(b.block, b.words, route, np.bincount(b.local, b.of_words(b.train), len(b.words)).astype(np.int64))

    def total(hashes: np.ndarray, sender: np.ndarray, n: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(hashes, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, inverse, n)
        return sums[inverse]

    def summary(hashes: np.ndarray, sender: np.ndarray, n: np.ndarray, c: np.ndarray) -> list:
        """Tokens and distinct words of the bucket, and its most frequent words."""
        distinct, at = np.unique(hashes, return_index=True)
        c = c[at]
        often = np.argsort(-c, kind="stable")[:FREQUENT]
        frequent = [{"hash": int(h), "n": int(x)} for h, x in zip(distinct[often].view(np.int64), c[often], strict=True) if x]
        return [int(c.sum()), int((c > 0).sum()), frequent]

    counted = cut(answer(alone(count, asked(1)), route, [np.int64], np.int64, total, "n bigint, v bigint, frequent array<struct<hash:bigint,n:bigint>>", summary), "counts")
    sums = counted.where("sender is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = rows.where("train").count()
    n_all, v_all = sums[0] + ends, sums[1] + (ends > 0)
    frequent = counted.where("sender is null").select(F.inline("frequent")).orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    hashes = np.array([r.hash for r in frequent], np.int64).view(np.uint64)
    size = len(hashes) + 1
    few = broadcast((np.sort(hashes), np.argsort(hashes)))

    def among(h: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
        """The value of each word that is among the frequent ones, whose values are given in their order; else `other`."""
        ordered, index = few.value
        if not len(index):
            return np.full(len(h), other)
        at = np.minimum(np.searchsorted(ordered, h), len(index) - 1)
        return np.where(ordered[at] == h, values[index[at]], other)

    def bigrams(b: _Block) -> pa.Table:
        """Counts of pairs of frequent words and ends."""
        seq, before, chosen = b.sequence(among(b.words, np.arange(size - 1), -1), size - 1)
        pair, n = np.unique((before * size + seq)[chosen & (seq >= 0) & (before >= 0)], return_counts=True)
        return pa.table({"pair": pair, "n": n})

    pairs = alone(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas().sort_values("pair")
    pair = pairs["pair"].to_numpy(np.int64)
    pair, n_pair = np.stack([pair // size, pair % size], 1), pairs["n"].to_numpy(float)
    of = cluster(pair, n_pair, size - 1, 1)
    table = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(table, (of[pair[:, 0]], of[pair[:, 1]]), n_pair)

    def neighbours(b: _Block, back: pa.Table | None = None) -> pa.Table:
        """Each word's counts of its neighbours' classes in training: how many counts, and these as code and number."""
        known = among(b.words, of, UNKNOWN) if back is None else answers(back, b.words, route, np.uint8)
        seq, before, chosen = b.sequence(known, END)
        after = np.append(seq[1:], END)
        word = np.insert(b.local.astype(np.int64), b.off[1:], -1)
        right, left = chosen & (word >= 0) & (after != UNKNOWN), chosen & (word >= 0) & (before != UNKNOWN)
        code, n = np.unique(np.concatenate([word[right] * 256 + after[right], word[left] * 256 + 128 + before[left]]), return_counts=True)
        runs = np.bincount(code >> 8, minlength=len(b.words))
        return ask(b.block, b.words, route, runs.astype(np.uint32), ragged=((code & 255).astype(np.uint8), n.astype(np.uint32)))

    def transitions(b: _Block, back: pa.Table) -> pa.Table:
        """Counts of pairs of classes in training."""
        seq, before, chosen = b.sequence(answers(back, b.words, route, np.uint8), END)
        pair, n = np.unique((before * 128 + seq)[chosen], return_counts=True)
        return pa.table({"pair": pair, "n": n})

    replies = None
    for _ in range(ROUNDS):
        shared = broadcast(table)

        def placed(hashes: np.ndarray, sender: np.ndarray, runs: np.ndarray, code: np.ndarray, n: np.ndarray, shared=shared) -> np.ndarray:
            distinct, inverse = np.unique(hashes, return_inverse=True)
            which, at = np.unique(np.repeat(inverse, runs) * 256 + code, return_inverse=True)
            made = place(which >> 8, which & 255, np.bincount(at, n, len(which)), len(distinct), shared.value)
            own = among(distinct, of, -1)
            return np.where(own >= 0, own, made).astype(np.uint8)[inverse]

        def vocabulary(hashes: np.ndarray, sender: np.ndarray, runs: np.ndarray, code: np.ndarray, n: np.ndarray, k: np.ndarray) -> list:
            """Distinct words of training by class."""
            _, at = np.unique(hashes[runs > 0], return_index=True)
            return [np.bincount(k[runs > 0][at], minlength=CLASSES).tolist()]

        questions = alone(neighbours, asked(3)) if replies is None else answered(replies, neighbours, asked(3))
        replies = cut(answer(questions, route, [np.uint32, np.uint8, np.uint32], np.uint8, placed, "v array<bigint>", vocabulary, ragged=2), "classes")
        table = np.zeros((CLASSES + 1, CLASSES + 1))
        for r in answered(replies, transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            table[r.pair // 128, r.pair % 128] = r.n
    v_class = np.zeros(CLASSES)
    for r in replies.where("sender is null").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        v_class[r.k] = r.v
    n_class = table.sum(0)[:CLASSES]
    moves, unseen = model_of(table, n_class, v_class)
    model = broadcast((np.log10(moves), n_class, np.log10(moves @ unseen)))

    def score(b: _Block, back: pa.Table) -> pa.Table:
        step, n_class, unknown = model.value
        c, k = (answers(back.filter(pa.compute.equal(back.column("kind"), i)), b.words, route, t).astype(np.int64) for i, t in ((0, np.int64), (1, np.uint8)))
        base = per_text(np.log10((c + 1) / (n_all + v_all + 1))[b.local], b.off) + np.log10((ends + 1) / (n_all + v_all + 1))
        emit = np.log10(np.maximum(c - DISCOUNT, DISCOUNT) / np.maximum(n_class[k], 1))
        seq, before, _ = b.sequence(np.where(c > 0, k, UNKNOWN), END)
        word = np.insert(emit[b.local], b.off[1:], 0)
        each = np.where(seq == UNKNOWN, unknown[before], step[before, np.minimum(seq, END)] + word)
        n = np.diff(b.off)
        ids = pa.array(b.ids, kind)
        return pa.table({"id": ids, "train": b.train, "n_tokens": n + 1, "n_known": per_text((c > 0)[b.local].astype(np.int64), b.off) + (ends > 0), "train_tokens": np.full(len(n), n_all, np.int64), "base_score": base, "score": per_text(each, b.off + np.arange(len(b.off)))})

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string("train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])
    kind = to_arrow_schema(out).field("id").type
    both = counted.select("sender", "bucket", "answers", F.lit(0).alias("kind")).unionByName(replies.select("sender", "bucket", "answers", F.lit(1).alias("kind")))
    return answered(both, score, out).withColumnRenamed("id", key)
