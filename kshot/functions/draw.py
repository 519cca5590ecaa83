"""Keyed random draws (P1) and distinct draws without rejection.

A draw is a pure function of ``(seed, key...)``: the md5 of the ``|``-joined key, first 15 hex digits
read as a 60-bit integer.  The same rows therefore come out for any partitioning, retry or engine
that implements md5 (the SQL twin is ``('0x' || substr(md5(key), 1, 15))::bigint``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_60 = float(1 << 60)


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def draw_key(seed, *parts) -> Column:
    """``seed|part1|part2...`` as a string column."""
    return F.concat_ws("|", F.lit(str(seed)), *[_part(p) for p in parts])


def keyed_hash(seed, *parts) -> Column:
    """Non-negative 60-bit integer drawn from ``(seed, parts)``."""
    return F.conv(F.substring(F.md5(draw_key(seed, *parts)), 1, 15), 16, 10).cast("bigint")


def keyed_index(n, seed, *parts) -> Column:
    """Uniform integer in ``[0, n)``; ``n`` is a Column or int (null when n <= 0)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n > 0, keyed_hash(seed, *parts) % n.cast("bigint"))


def keyed_uniform(seed, *parts) -> Column:
    """Uniform double in ``[0, 1)``."""
    return keyed_hash(seed, *parts) / F.lit(TWO_POW_60)


def order_key(seed, *parts) -> Column:
    """Hex md5 used as a random but reproducible sort key (its prefix is a uniform bucket)."""
    return F.md5(draw_key(seed, *parts))


def distinct_indices(n, k: int, seed, *parts) -> list[Column]:
    """``k`` distinct uniform indices in ``[0, n)`` (requires n >= k).

    Draw j is uniform in ``[0, n - j)`` and is moved past every earlier pick that is <= it, walking the
    earlier picks in ascending order; the result is an exact draw without replacement, row-local.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    picks: list[Column] = []
    for j in range(k):
        r = keyed_index(n - j, seed, *parts, f"d{j}")
        if picks:
            r = F.aggregate(
                F.array_sort(F.array(*picks)), r, lambda acc, p: acc + F.when(acc >= p, 1).otherwise(0)
            )
        picks.append(r)
    return picks


def shift_past(idx: Column, start: Column, width: Column) -> Column:
    """Map an index drawn from ``n - width`` values onto ``[0, n)`` skipping ``[start, start+width)``."""
    return F.when(idx >= start, idx + width).otherwise(idx)


def distinct_indices_array(n, k: int, seed, *parts) -> Column:
    """Array form of :func:`distinct_indices` for larger ``k``: one ``aggregate`` over ``0..k-1`` (linear
    expression size), identical draws.  Picks past ``n`` are null."""
    n = n if isinstance(n, Column) else F.lit(n)

    def step(acc, j):
        r = keyed_index(n - j, seed, *parts, F.concat(F.lit("d"), j.cast("string")))
        x = F.aggregate(F.array_sort(acc), r, lambda a, p: a + F.when(a >= p, 1).otherwise(0))
        return F.concat(acc, F.array(x))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), step)
