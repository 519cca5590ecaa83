"""Operator 13, exact dedup against a minimal perfect hash of historical digests.

Two texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``); the SHA-256 of what remains
stands for a text.  The distinct digests of the historical rows are dealt to shards of about ``SLOTS`` digests by their
leading bytes.  In each shard a minimal perfect hash (hash and displace: buckets, largest first, look for a seed that
sends all their digests to free slots) gives every digest a slot of its own; the slot holds the full digest, the number
of its rows and the locator of the row that stays.  A new batch is grouped by digest, meets its shard, and one slot a
digest is compared byte by byte: equal is a repeat (counts and winner of the slot are brought up to date), unequal is a
nonmember, a group of its own.

Scale: texts are read once and never shuffled, only (locator, id, digest, length) rows of some 60 bytes are.  Copies are
pre-aggregated in the map tasks, shards are uniform in the digest and bounded, and rows learn their group's winner by
``split_join``: the fewer than 1,000 digests with over a thousandth of all rows by broadcast, the rest by one shuffle
join, so that a group with a third of all rows is spread.

Edge cases: null text counts as empty, and all texts of white space alone are equal to it; of a group the row with the
most code points stays, then the smallest id (a null id after all others), then the first row in reading order, so
that of repeated ids exactly one row is kept.  An empty table gives no rows, an empty history makes every digest a
nonmember.  Only the id and the text are read: extra columns do not matter and are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import mix
from kshot.operators.joins import split_join
from kshot.session import staged

SLOTS = 1024
SPACE = " \t\n\x0b\x0c\r"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TRIES = 256


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 history: Column | None = None) -> DataFrame:
    """One narrow row per row of ``docs``: ``rid`` (locator), ``id``, ``digest`` (32 bytes), ``code_points``, ``old``
    (whether it belongs to the history; null counts as new).  Written once: ``rid`` never changes afterwards."""
    text = F.coalesce(docs[text_col], F.lit(""))
    old = F.lit(False) if history is None else F.coalesce(history, F.lit(False))
    return staged(docs.select(
        F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"),
        F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("code_points"), old.alias("old")), "dedup_rows")


def groups(rows: DataFrame) -> DataFrame:
    """``digest``, ``n`` and ``best`` of rows with equal digests; the least ``best`` is the row that stays."""
    best = F.struct((-F.col("code_points")).alias("minus"), F.col("id").isNull().alias("no_id"), "id", "rid")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _words(digests: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The four 64-bit words of every 32-byte digest."""
    flat = b"".join(digests.to_pylist())
    return np.frombuffer(flat, dtype="<u8").reshape(-1, 4)


def _slot(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slots of digests under their bucket's seed; a negative seed names the slot of a bucket of one digest."""
    tried = mix(words[:, 2] ^ mix(words[:, 3] + seeds.astype(np.uint64) * _STEP)) % np.uint64(n)
    return np.where(seeds < 0, -1 - seeds, tried.astype(np.int64))


def place(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets and the slot of each of ``n`` distinct digests: a bijection onto ``0 .. n - 1``."""
    n = len(words)
    n_buckets = -(-n // 3)
    bucket = (words[:, 1] % np.uint64(n_buckets)).astype(np.int64)
    size = np.bincount(bucket, minlength=n_buckets)
    by_bucket, first = np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(size)))
    seeds, slot, free = np.zeros(n_buckets, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        own, seed = by_bucket[first[b]:first[b + 1]], 0
        while True:
            tries = np.repeat(np.arange(seed, seed + _TRIES), len(own))
            at = _slot(np.tile(words[own], (_TRIES, 1)), tries, n).reshape(_TRIES, -1)
            fits = free[at].all(axis=1)
            ordered = np.sort(at, axis=1)
            fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                hit = int(np.argmax(fits))
                seeds[b], slot[own] = seed + hit, at[hit]
                free[at[hit]] = False
                break
            seed += _TRIES
    alone = np.flatnonzero(size == 1)
    left = np.flatnonzero(free)
    seeds[alone], slot[by_bucket[first[alone]]] = -1 - left, left
    return seeds, slot


def lookup(words: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot whose full digest equals each of ``words``, -1 for nonmembers."""
    if not len(slots):
        return np.full(len(words), -1)
    at = _slot(words, seeds[(words[:, 1] % np.uint64(len(seeds))).astype(np.int64)], len(slots))
    return np.where((slots[at] == words).all(axis=1), at, -1)


def build_index(old_groups: DataFrame, shards: int) -> DataFrame:
    """One row per slot: ``shard``, ``slot``, ``digest``, ``n``, ``best``; slot 0 also holds the shard's ``seeds``."""
    best = old_groups.schema["best"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        seeds, slot = place(_words(table["digest"]))
        order = np.empty(len(slot), np.int64)
        order[slot] = np.arange(len(slot))
        table = table.take(pa.array(order)).combine_chunks()
        held = pa.array([seeds.astype("<i8").tobytes()] + [None] * (len(slot) - 1), pa.binary())
        return table.append_column("slot", pa.array(np.arange(len(slot)), pa.int32())).append_column("seeds", held)

    dealt = old_groups.select(_shard(shards).alias("shard"), "digest", "n", "best")
    return staged(dealt.groupBy("shard").applyInArrow(
        build, f"shard int, digest binary, n long, best {best}, slot int, seeds binary"), "dedup_index")


def apply_batch(index: DataFrame, new_groups: DataFrame, shards: int) -> DataFrame:
    """Groups of history and batch together: every slot, brought up to date, and every nonmember (``slot`` null)."""
    best = index.schema["best"].dataType.simpleString()

    def meet(held: pa.Table, batch: pa.Table) -> pa.Table:
        held, batch = held.combine_chunks(), batch.combine_chunks()
        slots, words = _words(held["digest"]), _words(batch["digest"])
        order = np.argsort(held["slot"].to_numpy())       # rows of a group arrive in any order
        held, slots = held.take(pa.array(order)), slots[order]
        seeds = np.frombuffer(held["seeds"][0].as_py(), "<i8") if held.num_rows else np.zeros(0, np.int64)
        at = lookup(words, seeds, slots)
        partner = np.full(len(slots), -1)
        partner[at[at >= 0]] = np.flatnonzero(at >= 0)
        new = np.flatnonzero(at < 0)

        def side(table: pa.Table, name: str, rows: np.ndarray) -> pa.ChunkedArray:
            return table[name].take(pa.array(rows, mask=rows < 0))
        none = np.full(len(new), -1)
        mine, theirs = np.concatenate((np.arange(len(slots)), none)), np.concatenate((partner, new))
        digest = pa.chunked_array([*held["digest"].chunks, *batch["digest"].take(pa.array(new)).chunks], pa.binary())
        return pa.table({"digest": digest, "slot": side(held, "slot", mine), "old_n": side(held, "n", mine),
                         "old_best": side(held, "best", mine), "new_n": side(batch, "n", theirs),
                         "new_best": side(batch, "best", theirs)})

    dealt = new_groups.select(_shard(shards).alias("shard"), "digest", "n", "best")
    met = index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(
        meet, f"digest binary, slot int, old_n long, old_best {best}, new_n long, new_best {best}")
    return met.select("digest", "slot", (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"),
                      F.least("old_best", "new_best").alias("best"))


def dedup(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row of ``docs``.

    Rows where ``history`` holds are indexed, the others are looked up.
    """
    rows = fingerprints(docs, id_col, text_col, history)
    old, new = (staged(groups(rows.where(c)), "dedup_groups") for c in (F.col("old"), ~F.col("old")))
    shards = max(1, -(-max(old.count(), new.count()) // SLOTS))
    merged = staged(apply_batch(build_index(old, shards), new, shards), "dedup_merged")
    repeated = merged.where("n > 1").select("digest", "n", "best")
    found = split_join(rows.select("digest", "rid", "id"), repeated, "digest", ["rid"],
                       counts=merged.select("digest", F.col("n").alias("cnt")))
    single = F.col("n").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("best")["id"]).alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("n")).cast("long").alias("group_size"),
        (single | (F.col("best")["rid"] == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
