"""Losses and batch statistics over scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-7


def bce(p: Column, y: Column, eps: float = EPS) -> Column:
    """Binary cross-entropy of one pair, p clipped to [eps, 1-eps]."""
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(pc) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc))


def loss_bce_similarity(pairs: DataFrame, sim: str = "sim", label: str = "label") -> DataFrame:
    """Mean BCE of similarity vs label."""
    return pairs.agg(F.avg(bce(F.col(sim), F.col(label).cast("double"))).alias("loss"))


def contrastive_cosine(sim: Column, y: Column, t: float = 0.4) -> Column:
    return (y * (F.lit(1.0) - sim) * (F.lit(1.0) - sim) / 4.0
            + (F.lit(1.0) - y) * F.when(sim > F.lit(t), sim * sim).otherwise(F.lit(0.0)))


def loss_contrastive_cosine(pairs: DataFrame, sim: str = "sim", label: str = "label", t: float = 0.4) -> DataFrame:
    """E9."""
    return pairs.agg(F.avg(contrastive_cosine(F.col(sim), F.col(label).cast("double"), t)).alias("loss"))


def contrastive_euclidean(d: Column, y: Column, margin: float = 1.0) -> Column:
    m = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return y * d * d + (F.lit(1.0) - y) * m * m


def loss_contrastive_euclidean(pairs: DataFrame, dist: str = "dist", label: str = "label",
                               margin: float = 1.0) -> DataFrame:
    """E10."""
    return pairs.agg(F.avg(contrastive_euclidean(F.col(dist), F.col(label).cast("double"), margin)).alias("loss"))


def batch_loss_accuracy(scored: DataFrame, p: str = "p", label: str = "label", batch: str = "batch_id") -> DataFrame:
    """Per batch mean BCE and binary accuracy (threshold 0.5)."""
    y = F.col(label).cast("double")
    return scored.groupBy(batch).agg(
        F.avg(bce(F.col(p), y)).alias("loss"),
        F.avg(((F.col(p) > 0.5).cast("int") == F.col(label)).cast("int")).alias("accuracy"))
