"""Equi-joins that stay spread when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kshot.session import staged

#: A key with more than one ``SHARE``-th of all rows is hot, so there are fewer than ``SHARE`` hot keys.
SHARE = 1_000


def hot_keys(counts: DataFrame, key: str, n: str = "cnt", share: int = SHARE) -> DataFrame:
    """The keys of ``counts(key, n)`` with more than one ``share``-th of the total: fewer than ``share`` rows."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(n) * share > F.col("_total")).select(key)


#: Types that Spark's frequent-items sketch takes.
SKETCHED = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def frequent_keys(rows: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Every key with more than one ``share``-th of the rows (nulls aside), from one mergeable frequent-items sketch a
    task: no shuffle of the distinct keys.

    The sketch tracks ``16 * share`` items, so its counts are never too small and too large by less than a quarter of a
    ``share``-th of the rows: fewer than ``4 / 3 * share`` keys come back.
    """
    known = rows.where(F.col(key).isNotNull())
    seen = known.agg(F.expr(f"approx_top_k(`{key}`, {2 * share}, {16 * share})").alias("top"), F.count(F.lit(1)).alias("n"))
    return (seen.select("n", F.explode("top").alias("t")).where(F.col("t.count") * share > F.col("n"))
            .select(F.col("t.item").alias(key)))


def split_join(rows: DataFrame, table: DataFrame, key: str, spread: list[str], counts: DataFrame | None = None,
               share: int = SHARE) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique ``key``); ``spread`` names columns that tell rows of a key apart.

    Hot keys (counted by a sketch, or exactly in ``counts`` or for keys that are no strings or whole numbers) meet a
    broadcast of their own rows of ``table``, at most about ``share`` of them.  All rows then take one
    shuffle join on ``(key, spreader)``: the spreader is a hash of the key in ``table`` and on rows still to be joined
    (not a literal, which Spark would drop from the join's keys), and a negative hash of ``spread`` on the resolved
    ones and those without a key, which match nothing and travel apart.  ``counts(key, cnt)`` saves counting the keys.
    """
    payload = [c for c in table.columns if c != key]
    table = staged(table, "side")      # read twice; Spark knows the size of a written table and broadcasts a small one
    if counts is None and isinstance(rows.schema[key].dataType, SKETCHED):
        often = frequent_keys(rows, key, share)
    else:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")) if counts is None else counts
        often = hot_keys(counts, key, share=share)
    hot = staged(often.join(table, key, "left")
                 .select(key, F.struct(*payload).alias("_hot")), "hot_keys")
    def small_hash(*cols: str):
        return F.pmod(F.xxhash64(*cols), F.lit(1 << 30))
    first = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_apart", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), small_hash(key)).otherwise(-1 - small_hash(*spread)))
    rest = table.select(key, small_hash(key).alias("_apart"), F.struct(*payload).alias("_tail"))
    out = first.join(rest, [key, "_apart"], "left")
    own = [c for c in rows.columns if c != key]
    return out.select(key, *own, *[F.coalesce(F.col("_hot")[c], F.col("_tail")[c]).alias(c) for c in payload])


def small_join(rows: DataFrame, table: DataFrame, key: str | list[str], spread: str | list[str],
               max_broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Inner join of ``rows`` with a table of one narrow row per key: broadcast under a counted bound, else on
    ``(key, salt)`` so that a hot key is dealt over ``salts`` tasks.  ``spread`` tells rows of a key apart."""
    keys, apart = ([x] if isinstance(x, str) else list(x) for x in (key, spread))
    if table.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return rows.join(F.broadcast(table), keys)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = rows.withColumn("_salt", F.pmod(F.xxhash64(*apart), F.lit(salts)).cast("int"))
    return mine.join(salted, [*keys, "_salt"]).drop("_salt")
