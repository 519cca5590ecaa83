"""Binary and macro-averaged metrics (G1-G10, L2), all from one confusion aggregation.

``pred`` / ``actual`` are label columns.  Empty input gives 0 for every metric, zero denominators give
0, and a label that is never predicted has precision 0 - the conventions of the original scripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f_beta_expr(p: Column, r: Column, beta: float) -> Column:
    b2 = float(beta) * float(beta)
    den = F.lit(b2) * p + r
    return F.when(den != 0, F.lit(1.0 + b2) * p * r / den).otherwise(F.lit(0.0))


def first_pred(pred: Column, dtype: str) -> Column:
    """List-valued predictions use their first element."""
    return F.element_at(pred, 1) if dtype.startswith("array") else pred


def mean_or_zero(df: DataFrame, col: str, alias: str = "mean") -> DataFrame:
    """G1."""
    return df.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias(alias))


def confusion(df: DataFrame, pred: str = "pred", true: str = "actual") -> DataFrame:
    """``(true, pred, n)``: the one shuffle every metric reads (partial aggregation map-side)."""
    p = first_pred(F.col(pred), dict(df.dtypes)[pred])
    return df.groupBy(F.col(true).alias("actual"), p.alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _binary_parts(conf: DataFrame, positive) -> DataFrame:
    pos = F.lit(positive)
    return conf.agg(
        F.coalesce(F.sum(F.col("n")), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("pred") == F.col("actual"), F.col("n"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when((F.col("pred") == pos) & (F.col("actual") == pos), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("pred") == pos, F.col("n"))), F.lit(0)).alias("pp"),
        F.coalesce(F.sum(F.when(F.col("actual") == pos, F.col("n"))), F.lit(0)).alias("ap"),
    )


def binary_metrics(df: DataFrame, pred: str = "pred", true: str = "actual", beta: float = 1.0,
                   positive=1) -> DataFrame:
    """One row ``(accuracy, recall, precision, f_beta)``."""
    parts = _binary_parts(confusion(df, pred, true), positive)
    prec = _ratio(F.col("tp"), F.col("pp"))
    rec = _ratio(F.col("tp"), F.col("ap"))
    return parts.select(
        _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        rec.alias("recall"),
        prec.alias("precision"),
        f_beta_expr(prec, rec, beta).alias("f_beta"),
    )


def accuracy(df: DataFrame, pred: str = "pred", true: str = "actual") -> DataFrame:
    """G2."""
    return binary_metrics(df, pred, true).select("accuracy")


def binary_precision(df, pred="pred", true="actual", positive=1) -> DataFrame:
    """G3."""
    return binary_metrics(df, pred, true, positive=positive).select("precision")


def binary_recall(df, pred="pred", true="actual", positive=1) -> DataFrame:
    """G4."""
    return binary_metrics(df, pred, true, positive=positive).select("recall")


def binary_f_beta(df, pred="pred", true="actual", beta=1.0, positive=1) -> DataFrame:
    """G5."""
    return binary_metrics(df, pred, true, beta, positive).select("f_beta")


def per_label(df: DataFrame, labels: DataFrame, pred: str = "pred", true: str = "actual",
              beta: float = 1.0, label_col: str = "label") -> DataFrame:
    """Per-label ``(label, precision, recall, f_beta)`` for every label of ``labels``.

    Each confusion cell counts once for its true label (ap, and tp when correct) and once for its
    predicted label (pp): one exploded aggregation over the small confusion table.
    """
    conf = confusion(df, pred, true)
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("ap"), F.lit(0).cast("long").alias("pp"),
                 F.when(F.col("pred") == F.col("actual"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("ap"), F.col("n").alias("pp"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")
    counts = conf.select(sides).select("s.*").groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("ap").alias("ap"))
    lab = labels.select(F.col(label_col).alias("label"))
    j = lab.join(counts, "label", "left")
    prec = _ratio(F.coalesce(F.col("tp"), F.lit(0)), F.coalesce(F.col("pp"), F.lit(0)))
    rec = _ratio(F.coalesce(F.col("tp"), F.lit(0)), F.coalesce(F.col("ap"), F.lit(0)))
    return j.select("label", prec.alias("precision"), rec.alias("recall"), f_beta_expr(prec, rec, beta).alias("f_beta"))


def multi_metrics(df: DataFrame, labels: DataFrame, pred: str = "pred", true: str = "actual",
                  beta: float = 1.0, label_col: str = "label") -> DataFrame:
    """One row ``(accuracy, recall, precision, f_beta)`` with macro means over ``labels``."""
    per = per_label(df, labels, pred, true, beta, label_col).agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg("f_beta"), F.lit(0.0)).alias("f_beta"))
    conf = confusion(df, pred, true)
    acc = conf.agg(_ratio(F.coalesce(F.sum(F.when(F.col("pred") == F.col("actual"), F.col("n"))), F.lit(0)),
                          F.coalesce(F.sum("n"), F.lit(0))).alias("accuracy"))
    return acc.crossJoin(per).select("accuracy", "recall", "precision", "f_beta")


def multi_precision(df, labels, pred="pred", true="actual", label_col="label") -> DataFrame:
    """G7."""
    return multi_metrics(df, labels, pred, true, label_col=label_col).select("precision")


def multi_recall(df, labels, pred="pred", true="actual", label_col="label") -> DataFrame:
    """G8."""
    return multi_metrics(df, labels, pred, true, label_col=label_col).select("recall")


def multi_f_beta(df, labels, pred="pred", true="actual", beta=1.0, label_col="label") -> DataFrame:
    """G9."""
    return multi_metrics(df, labels, pred, true, beta, label_col).select("f_beta")


# L2: metric selection by name; each builder maps a prediction frame to a one-row frame.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "accuracy": lambda df, **kw: binary_metrics(df, **kw).select("accuracy"),
    "recall": lambda df, **kw: binary_metrics(df, **kw).select("recall"),
    "precision": lambda df, **kw: binary_metrics(df, **kw).select("precision"),
    "f_beta": lambda df, **kw: binary_metrics(df, **kw).select("f_beta"),
}


def select_metrics(df: DataFrame, names: list[str], **kw) -> DataFrame:
    """L2: ``(metric, value)`` rows for the named metrics, computed from one confusion table."""
    row = binary_metrics(df, **kw)
    for n in names:
        if n not in METRICS:
            raise KeyError(f"unknown metric {n!r}; known: {sorted(METRICS)}")
    stack = ", ".join(f"'{n}', {n}" for n in names)
    return row.selectExpr(f"stack({len(names)}, {stack}) as (metric, value)")
