"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

A batch of texts is one uint8 array plus document offsets, so words, word hashes and
word-window hashes come from a few numpy passes instead of a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are runs of anything but these bytes: the ASCII blanks, or ASCII that is neither digit nor letter.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NON_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z on UTF-8 bytes; bytes of other characters stay.
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
#: Texts are worked on in pieces of about so many bytes, which bounds the memory of a Python worker.
PIECE_BYTES = 2_000_000

_LOWER = np.frombuffer(LOWER, np.uint8)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def separators(chars: bytes) -> np.ndarray:
    """Lookup table by byte: True for separators."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, _U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[0] = (out[0], out[1])
    return have


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes."""
    data, off = utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + size, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes that don't cross texts, and offsets of the texts in runs."""
    inside = np.append(inside, False)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[:-1]
    open_ = inside.copy()
    open_[1:] &= ~before[1:]
    open_[cut] = inside[cut]  # a text starts afresh
    starts = np.flatnonzero(open_)
    close = before & ~inside
    close[cut] = before[cut]
    close[off[-1]] = before[off[-1]]
    ends = np.flatnonzero(close)
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and offsets of the texts in words."""
    return runs(~sep[data], off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether these stand within one text."""
    size = len(hashes)
    out, whole = np.zeros(size, np.uint64), np.zeros(size, bool)
    if size >= n:
        up, down = _power(size + 1)
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * up[:size], out=total[1:])
        at = np.arange(size - n + 1)
        out[at] = mix((total[n:] - total[:-n]) * down[at])
        ends = np.repeat(off[1:], np.diff(off))
        whole[at] = at + n <= ends[at]
    return out, whole


def covered(marks: np.ndarray, n: int) -> np.ndarray:
    """Words that lie in a window of n words from a marked word on."""
    step = np.zeros(len(marks) + n + 1, np.int32)
    at = np.flatnonzero(marks)
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[: len(marks)]) > 0


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values of each text's words."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]
