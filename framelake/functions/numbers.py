"""Numbers as if drawn at random, made from counters: integers only, so any engine that has these gets the same.

mixed() is a bijection of 64 bits, a Feistel network over two halves of 32. So different keys have
different numbers, at any number of keys; permuted() is a bijection of the places below n.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd multipliers below 2**30, one a round: a half times one of them fits into 62 bits.
FACTORS = (0x2545F491, 0x1B873593, 0x3C6EF35F, 0x27D4EB2F, 0x165667B1, 0x2C1B3C6D)
MASK = (1 << 32) - 1
#: Steps from a number outside of the places to one within: at least as many as there are such numbers where places are few.
WALK = 48

T = TypeVar("T")


def keys_of(seed: int) -> list[int]:
    """What each round adds."""
    return [(seed * 0x9E3779B1 + (i + 1) * 0x85EBCA77) & MASK for i in range(len(FACTORS))]


def rounds(left: T, right: T, seed: int, step: Callable[[T, T, int, int], T]) -> tuple[T, T]:
    """Halves after all rounds; step(left, right, factor, key) is left xor the middle bits of right * factor + key."""
    for factor, key in zip(FACTORS, keys_of(seed), strict=True):
        left, right = right, step(left, right, factor, key)
    return left, right


def mixed(key: Column, seed: int = 0) -> tuple[Column, Column]:
    """Two numbers below 2**32 for an integer key."""
    key = key.cast("long")
    half = lambda x: x.bitwiseAND(F.lit(MASK))
    return rounds(half(F.shiftright(key, 32)), half(key), seed, lambda a, b, c, k: a.bitwiseXOR(half(F.shiftright(b * F.lit(c) + F.lit(k), 15))))


def number(key: Column, seed: int = 0) -> Column:
    """A long for an integer key, different for each."""
    high, low = mixed(key, seed)
    return (high.bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)) * F.lit(1 << 32) + low


def below(key: Column, n: int, seed: int = 0) -> Column:
    """A number below n, a small integer, for an integer key."""
    return F.shiftright(mixed(key, seed)[0] * F.lit(n), 32)


def uniform(key: Column, seed: int = 0, signed: bool = False) -> Column:
    """A double in [0, 1), or in [-1, 1) if signed, with 32 bits."""
    high = mixed(key, seed)[0]
    return high / F.lit(float(1 << 31)) - 1 if signed else high / F.lit(float(1 << 32))


def grid_of(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n by less than a: places below n are a part of an a x b grid."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(place: Column, n: int, seed: int = 0) -> Column:
    """The place below n that a place goes to: a bijection, by rounds on the rows and columns of a grid; who leaves the places goes on until within."""
    a, b = grid_of(n)
    ks = keys_of(seed)

    def turned(x: Column, i: int) -> Column:
        middle = F.shiftright(x * F.lit(FACTORS[i]) + F.lit(ks[i]), 15).bitwiseAND(F.lit(MASK >> 2))
        return F.shiftright(middle * middle, 15)  # a square, so that rounds don't add up to a straight line

    def once(v: Column) -> Column:
        row, column = F.call_function("div", v, F.lit(b)), v % b
        for i in (0, 2):
            column = (column + turned(row, i)) % b
            row = (row + turned(column, i + 1)) % a
        return row * b + column

    place = place.cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(place), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return walk.cast("long")
