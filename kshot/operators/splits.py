"""Class splits, positional splits, shuffles and batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kshot.functions.draw import order_key
from kshot.functions.permute import permuted
from kshot.operators.joins import small_join
from kshot.operators.labels import MAX_ROWS, label_index, ranked_classes
from kshot.operators.positions import Indexed, global_position, hashed_position, member_index
from kshot.session import staged


def split_classes(items: DataFrame, frac: float, seed, class_col: str = "class",
                  first: str = "train", rest: str = "validation", max_rows: int = MAX_ROWS) -> DataFrame:
    """Class-disjoint split; ``floor(frac * C)`` classes drawn without replacement go to ``first``."""
    ranked, n = ranked_classes(items, class_col, [order_key(seed, F.col(class_col)), F.col(class_col)], "_rank", max_rows)
    return ranked.select(class_col, F.when(F.col("_rank") <= math.floor(n * float(frac)), F.lit(first))
                         .otherwise(F.lit(rest)).alias("split"))


def background_evaluation(items: DataFrame, frac: float, seed, class_col: str = "class",
                          item_col: str = "item_id") -> DataFrame:
    """Tag items with ``split`` in (background, evaluation) by a class-level split."""
    split = split_classes(items, frac, seed, class_col, "background", "evaluation")
    return small_join(items, split, class_col, item_col)


def restrict(items: DataFrame, split: DataFrame, which: str, class_col: str = "class") -> DataFrame:
    """Keep items whose class is in split ``which`` (semi join, class table is small)."""
    return items.join(split.where(F.col("split") == which).select(class_col), class_col, "left_semi")


def positional_split(rows: DataFrame, pos: str = "pos", used: float = 0.8, validation: float = 0.2) -> DataFrame:
    """First ``floor(used*n)`` rows are used; their last ``validation`` share is the validation part.

    ``part`` is train / validation / unused.
    """
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    m = F.floor(F.col("_n") * F.lit(used))
    cut = F.floor(m * F.lit(1.0 - validation))
    return (rows.crossJoin(n)
            .withColumn("part", F.when(F.col(pos) <= cut, "train").when(F.col(pos) <= m, "validation")
                        .otherwise("unused"))
            .drop("_n"))


def shuffle(rows: DataFrame, seed, key: str, out: str = "pos") -> DataFrame:
    """C4: random permutation position keyed by ``md5(seed|key)``."""
    return hashed_position(rows, seed, F.col(key), out)


def minibatches(rows: DataFrame, batch: int, pos: str = "pos") -> DataFrame:
    """``batch_id = (pos-1) div B``; the incomplete last batch is dropped."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    bid = F.floor((F.col(pos) - 1) / F.lit(batch)).cast("bigint")
    return (rows.crossJoin(n).withColumn("batch_id", bid)
            .where(F.col("batch_id") < F.floor(F.col("_n") / F.lit(batch))).drop("_n"))


def number_rows(rows: DataFrame, key: str, out: str = "number", per_bucket: int = 1 << 16) -> DataFrame:
    """Rows numbered from 0 in the order of a whole-number ``key`` (null keys first, which is one bucket), written once."""
    bucket = F.floor(F.col(key) / per_bucket)
    return staged(global_position(rows, [F.col(key)], [F.coalesce(bucket, F.lit(-(1 << 62)))], out).withColumn(out, F.col(out) - 1), "numbered")


def permuted_epochs(numbered: DataFrame, n: int, seed, epochs: int, batch: int, number: str = "number") -> DataFrame:
    """C4 and C5 over several epochs: every row once an epoch, with ``epoch``, ``pos`` (from 1) and ``batch_id``; the
    incomplete last batch of an epoch is dropped.  Row-local: nothing is sorted or shuffled after the numbering."""
    spread = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = spread.withColumn("pos", permuted(F.col(number), n, seed, F.col("epoch")) + 1)
    return (placed.withColumn("batch_id", F.floor((F.col("pos") - 1) / batch).cast("bigint"))
            .where(F.col("batch_id") < n // batch))


def draw_support(items: DataFrame, k: int, seed, class_col: str = "class", item_col: str = "item_id",
                 max_broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6 without numbering the items: ``(support, queries, labels)`` with the rows of ``support_query_split``.

    The first ``k`` items of every class are found on ``(class, item)`` alone (Spark keeps ``k`` per class and task
    before the shuffle) and written; the items lose them by an anti join, so vectors are not shuffled while the
    support is under the broadcast bound.
    """
    h = order_key(seed, "m", F.col(item_col))
    first = Window.partitionBy(class_col).orderBy("_h", item_col)
    ids = staged(items.select(class_col, item_col, h.alias("_h")).withColumn("_k", F.row_number().over(first))
                 .where(F.col("_k") <= k).select(item_col), "support_ids")
    few = ids.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    ids = F.broadcast(ids) if few else ids
    labels = label_index(items, class_col)          # of a written class table

    def tag(part: DataFrame) -> DataFrame:
        return small_join(part, labels, class_col, item_col, max_broadcast_rows)
    return tag(items.join(ids, item_col, "left_semi")), tag(items.join(ids, item_col, "left_anti")), labels


def support_query_split(items: DataFrame, k: int, seed, class_col: str = "class",
                        item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Per class the first ``k`` members (random order) are support, the rest are queries.

    Returns ``(tagged items with role/member_idx/class_idx, label table (class, class_idx))``.
    """
    idx: Indexed = member_index(items, seed, class_col, item_col)
    labels = label_index(items, class_col)
    tagged = (small_join(idx.items, labels, class_col, item_col)
              .withColumn("role", F.when(F.col("member_idx") < k, "support").otherwise("query")))
    return tagged, labels
