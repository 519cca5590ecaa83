"""Global positions and per-class member indices without a single-partition window.

A total order is cut into buckets by an order-preserving prefix of the sort key.  Bucket sizes are a
small table whose running sum gives each bucket's offset; inside a bucket a ``row_number`` finishes
the job.  A key that holds a third of the rows is still spread over many buckets because the
bucket includes a hash prefix (P3) or a token prefix (vocabularies).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kshot.functions.draw import order_key
from kshot.session import staged

_UNB = Window.unboundedPreceding


#: Buckets under one parent: a window over buckets is never longer than this, but for the topmost of a few levels.
FAN = 4096


def _before(table: DataFrame, partition: list[str], buckets: list[str], value: str, aggregate, out: str, levels: int) -> DataFrame:
    """``aggregate`` (sum or max) of ``value`` over the earlier buckets of a partition, null at the first.

    One whole-number bucket column is taken in ``levels`` levels of ``FAN`` buckets, so that no window task grows with
    the number of buckets: 4096 ** 2 buckets to a row of the topmost window at two levels."""
    whole = len(buckets) == 1 and isinstance(table.schema[buckets[0]].dataType, (T.LongType, T.IntegerType, T.DecimalType))
    earlier = Window.orderBy(*buckets).rowsBetween(_UNB, -1)
    if not whole or not levels:
        w = Window.partitionBy(*partition).orderBy(*buckets).rowsBetween(_UNB, -1) if partition else earlier
        return table.withColumn(out, aggregate(value).over(w))
    up, over = f"_up{levels}", f"_above{levels}"
    parent = table.withColumn(up, F.floor(F.col(buckets[0]) / FAN).cast("long"))
    above = _before(parent.groupBy(*partition, up).agg(aggregate(value).alias(value)), partition, [up], value, aggregate,
                    over, levels - 1).drop(value)
    inside = Window.partitionBy(*partition, up).orderBy(*buckets).rowsBetween(_UNB, -1)
    both = parent.withColumn("_in", aggregate(value).over(inside)).join(above, [*partition, up])
    total = F.greatest(over, "_in") if aggregate is F.max else F.coalesce(F.col(over) + F.col("_in"), over, "_in")
    return both.withColumn(out, total).drop(up, "_in", over)


def global_position(df: DataFrame, order: list[Column], bucket: list[Column], out: str = "pos",
                    partition: list[str] | None = None) -> DataFrame:
    """1-based position of every row in ``order`` (within ``partition``), as bigint.

    A single whole-number bucket may take any number of values (see ``_before``); others should take a bounded number."""
    partition = partition or []
    bnames = [f"_b{i}" for i in range(len(bucket))]
    b = df.select("*", *[c.alias(n) for c, n in zip(bucket, bnames)])
    sizes = b.groupBy(*partition, *bnames).agg(F.count(F.lit(1)).alias("_bn"))
    offsets = _before(sizes, partition, bnames, "_bn", F.sum, "_boff", 0 if partition else 2)
    offsets = offsets.select(*partition, *bnames, F.coalesce("_boff", F.lit(0)).alias("_boff"))
    ranked = b.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition, *bnames).orderBy(*order)))
    return (ranked.join(offsets, [*partition, *bnames])
            .withColumn(out, (F.col("_boff") + F.col("_rn")).cast("bigint"))
            .drop(*bnames, "_boff", "_rn"))


def ranged_position(df: DataFrame, order: list[Column], out: str = "pos", rows_per_range: int = 100_000) -> DataFrame:
    """1-based position of every row in ``order`` (which must tell all rows apart), without a prefix of the key.

    Rows are dealt into sampled ranges of about ``rows_per_range`` rows and written with their range number, so that
    the numbers are fixed; then ``global_position`` takes the range as bucket.
    """
    df = staged(df, "unranked")
    n = max(1, -(-df.count() // rows_per_range))
    dealt = staged(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return global_position(dealt, order, [F.col("_range")], out).drop("_range")


def hashed_position(df: DataFrame, seed, key: Column, out: str = "pos", digits: int = 4,
                    partition: list[str] | None = None) -> DataFrame:
    """Random permutation position (1-based) ordered by ``md5(seed|key)`` then ``key``."""
    h = order_key(seed, key)
    return global_position(df.withColumn("_h", h), [F.col("_h"), key], [F.substring("_h", 1, digits)],
                           out, partition).drop("_h")


@dataclass
class Indexed:
    """Items with ``member_idx`` (0-based, random order inside the class) and the class table."""

    items: DataFrame      # (*items cols, member_idx bigint, n bigint)
    classes: DataFrame    # (class, n bigint)


def member_index(items: DataFrame, seed, class_col: str = "class", item_col: str = "item_id",
                 rows_per_bucket: int = 100_000) -> Indexed:
    """Random member index inside each class, keyed by ``md5(seed|m|item)``.

    The hash-prefix length of a class's buckets grows with the class size (about ``rows_per_bucket``
    rows per window task), so a class holding a third of all items is still thousands of tasks while
    small classes stay one bucket.
    """
    classes = items.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    digits = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("n") / F.lit(float(rows_per_bucket))))))
    # joined on (class, salt): a join on the class alone would gather a hot class, and its partitioning would
    # satisfy the window below, so that the buckets would spread nothing
    salts = 32
    sized = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(F.col(item_col)), F.lit(salts)).cast("int"))
    keyed = salted.join(sized, [class_col, "_salt"]).drop("_salt").withColumn("_h", order_key(seed, "m", F.col(item_col)))
    ranked = global_position(keyed, [F.col("_h"), F.col(item_col)], [F.col("_h").substr(F.lit(1), digits.cast("int"))],
                             "member_idx", partition=[class_col])
    ranked = ranked.withColumn("member_idx", F.col("member_idx") - 1).drop("_h")
    return Indexed(ranked, classes)


def class_offsets(classes: DataFrame, class_col: str = "class") -> DataFrame:
    """Exclusive running sum of class sizes in class order: ``(class, n, off)``.

    The class table has one row per class (far fewer than items), so one ordered window is enough.
    """
    w = Window.orderBy(class_col).rowsBetween(_UNB, -1)
    return classes.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("bigint"))


def running_max_before(df: DataFrame, value: Column, order: list[Column], bucket: list[Column], out: str,
                       partition: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Running max of ``value`` over earlier rows (or up to the current row) in ``order`` per ``partition``.

    Bucket maxima form a small table whose prefix max is joined back, so a partition holding a third
    of all rows is still processed as many bucket-sized window tasks.
    """
    partition = partition or []
    bnames = [f"_b{i}" for i in range(len(bucket))]
    b = df.select("*", *[c.alias(n) for c, n in zip(bucket, bnames)], value.alias("_v"))
    bmax = b.groupBy(*partition, *bnames).agg(F.max("_v").alias("_bm"))
    prev_b = _before(bmax, partition, bnames, "_bm", F.max, "_pb", 1).select(*partition, *bnames, "_pb")
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(*partition, *bnames).orderBy(*order).rowsBetween(_UNB, end)
    inner = b.withColumn("_pi", F.max("_v").over(w_in))
    return (inner.join(prev_b, [*partition, *bnames])
            .withColumn(out, F.greatest(F.col("_pb"), F.col("_pi")))
            .drop(*bnames, "_v", "_pb", "_pi"))
