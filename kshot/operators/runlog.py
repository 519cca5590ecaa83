"""Training-log analytics over ``(run, iteration, loss, accuracy, validation)``.

Iterations are 1-based.  Running statistics per run use bucketed prefix maxima (blocks of
iterations), so one very long run is still many window tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.operators.positions import running_max_before

BLOCK = 1024


def _bucket():
    return [F.floor((F.col("iteration") - 1) / BLOCK)]


def schedule(log: DataFrame, lr: float, slope: float, final: float, every: int = 500) -> DataFrame:
    """Learning rate and momentum after each logged iteration: lr x 0.99 every ``every``
    iterations; momentum from 0.5 grows by ``slope`` while below ``final`` (may overshoot one step)."""
    steps = F.ceil(F.round(F.lit((final - 0.5) / slope), 9))
    return log.select("run", "iteration",
                      (F.lit(lr) * F.pow(F.lit(0.99), F.floor(F.col("iteration") / every))).alias("lr"),
                      (F.lit(0.5) + F.lit(slope) * F.least(F.col("iteration"), steps)).alias("momentum"))


def log_windows(log: DataFrame, w: int) -> DataFrame:
    """Blocks of ``w`` iterations per run: mean loss / accuracy, validation of the block's last row;
    incomplete blocks are not flushed."""
    blk = F.floor((F.col("iteration") - 1) / w).cast("bigint")
    return (log.groupBy("run", blk.alias("block"))
            .agg(F.count(F.lit(1)).alias("_n"), F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"),
                 F.max_by("validation", "iteration").alias("validation"))
            .where(F.col("_n") == w).drop("_n"))


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Rows whose validation beats every earlier validation of the run (best starts at 0)."""
    prev = running_max_before(log, F.col("validation"), [F.col("iteration")], _bucket(), "_prev", ["run"])
    return prev.where(F.col("validation") > F.coalesce(F.col("_prev"), F.lit(0.0))).drop("_prev")


def early_stop(log: DataFrame, patience: int) -> DataFrame:
    """I4: first iteration more than ``patience`` after the last improvement so far.

    Iterations count from 1 here; before any improvement the first iteration counts as the last one."""
    prev = running_max_before(log, F.col("validation"), [F.col("iteration")], _bucket(), "_prev", ["run"])
    imp = prev.withColumn("_imp", F.when(F.col("validation") > F.coalesce(F.col("_prev"), F.lit(0.0)),
                                         F.col("iteration")).otherwise(F.lit(1)))
    last = running_max_before(imp.drop("_prev"), F.col("_imp"), [F.col("iteration")], _bucket(), "_last", ["run"],
                              inclusive=True)
    return (last.where(F.col("iteration") - F.col("_last") > patience)
            .groupBy("run").agg(F.min("iteration").alias("stop_iteration")))


def collapse_stop(log: DataFrame, every: int = 1) -> DataFrame:
    """First evaluation point (iteration % every == 0) where validation = 1 and accuracy = 0.5,
    or accuracy = 0 (the run is aborted with result 0)."""
    cond = ((F.col("validation") == 1.0) & (F.col("accuracy") == 0.5)) | (F.col("accuracy") == 0.0)
    return (log.where((F.col("iteration") % every == 0) & cond)
            .groupBy("run").agg(F.min("iteration").alias("stop_iteration")))


def best_run(log: DataFrame) -> DataFrame:
    """Best validation per run, then the run with the least objective 1 - best (lowest run on ties)."""
    per = log.groupBy("run").agg(F.max("validation").alias("best_validation"))
    per = per.withColumn("objective", F.lit(1.0) - F.col("best_validation"))
    best = per.agg(F.min_by(F.struct("run", "best_validation", "objective"),
                            F.struct("objective", "run")).alias("b"))
    return best.select("b.run", "b.best_validation", "b.objective")
