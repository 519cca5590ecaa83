"""Class tables: class -> dense index (B15) and the order-preserving bucket used for class tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kshot.operators.positions import ranged_position
from kshot.session import staged

#: Class tables up to this size are ordered in one task.
MAX_ROWS = 100_000
_NUMERIC = ("int", "bigint", "smallint", "tinyint")


def class_bucket(df: DataFrame, col: str) -> list[Column]:
    """Order-preserving prefix of a class key (numeric block or first character)."""
    if dict(df.dtypes)[col] in _NUMERIC:
        return [F.floor(F.col(col) / 4096)]
    return [F.substring(F.col(col), 1, 1)]


def ranked_classes(items: DataFrame, class_col: str, order: list[Column], out: str, max_rows: int = MAX_ROWS) -> tuple[DataFrame, int]:
    """The distinct classes with their position (from 1) in ``order``, and their number.

    The class table is written and counted: up to ``max_rows`` rows take one ordered window, more are dealt into ranges.
    """
    classes = staged(items.select(class_col).distinct(), "classes")
    n = classes.count()
    if n <= max_rows:
        return classes.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint")), n
    return ranged_position(classes, order, out, max_rows), n


def label_index(items: DataFrame, class_col: str = "class", max_rows: int = MAX_ROWS) -> DataFrame:
    """``(class, class_idx)`` with class_idx = 0..C-1 in ascending class order."""
    ranked, _ = ranked_classes(items, class_col, [F.col(class_col)], "class_idx", max_rows)
    return ranked.withColumn("class_idx", F.col("class_idx") - 1)
