"""Keyed permutation of positions (C4, C5): a Feistel network on ``[0, n)``, computed row by row.

Numbers below ``a * b`` (``a`` the square root of ``n`` rounded up, ``b`` the least with ``a * b >= n``) are split into
``x mod a`` and ``x div a``; every round adds a keyed hash (P1) of one half to the other, alternately mod ``a`` and mod
``b``.  That is a bijection on ``[0, a * b)``.  Of these fewer than ``a`` are not below ``n``; such a result is permuted
again until it is (cycle walking), which is a bijection on ``[0, n)`` and takes as many steps as there are numbers left
over at most.  No sort, no window, no exchange: the position of a row in an epoch depends on its number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kshot.functions.draw import keyed_hash

ROUNDS = 6
#: Steps that are tried: above 1,000 numbers each fails with a chance under 1 / sqrt(n), below it this is the proven bound.
WALK = 32


def halves(n: int) -> tuple[int, int]:
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    return a, -(-n // a)


def _network(x: Column, a: int, b: int, seed, parts: tuple) -> Column:
    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("bigint").alias("r"))

    def turn(s: Column, j: Column) -> Column:
        size = F.when(j % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("bigint")
        return F.struct(s["r"].alias("l"), ((s["l"] + keyed_hash(seed, *parts, j, s["r"])) % size).alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.element_at(F.transform(F.array(done), lambda s: s["l"] + s["r"] * a), 1)


def permuted(number: Column, n: int, seed, *parts) -> Column:
    """The place of ``number`` (from 0, below ``n``) in the permutation of ``(seed, parts)``; null outside of ``[0, n)``."""
    a, b = halves(max(n, 1))
    x = number.cast("bigint")
    first = _network(x, a, b, seed, parts)
    spare = a * b - n
    if spare:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(min(spare, WALK))), first,
                             lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, seed, parts)))
        first = F.element_at(F.transform(F.array(walked), lambda y: F.when(y < n, y).otherwise(
            F.raise_error(F.lit("cycle walking did not end")).cast("bigint"))), 1)
    return F.when((x >= 0) & (x < n), first)
