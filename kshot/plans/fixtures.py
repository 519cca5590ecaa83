"""Frames the operators run on, derived from the given parquet tables (see FIXTURES.md).

Only the columns an operator needs are selected, so parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kshot.operators.positions import global_position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id bigint, class int, vec array<float>)`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("class"), F.col("embedding").alias("vec"))


def items_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, superclass, class, text)`` from ``documents``: superclass = lang, class = lang/source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("superclass"),
        F.concat_ws("/", "lang", "source").alias("class"), F.col("text"))


def images(spark: SparkSession, sf_dir: str, rows: int = 8, cols: int = 8) -> DataFrame:
    """``(item_id, class, rows, cols, pixels array<double>)``: embeddings viewed as 8x8 row-major."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("class"),
        F.lit(rows).alias("rows"), F.lit(cols).alias("cols"),
        F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, pred, actual)`` from ``labels``: pred = quality, true = toxic."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("pred"), F.col("toxic").alias("actual"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, iteration, loss, accuracy, validation)`` from ``events``.

    iteration = 1-based position per run by (ts, event_id); hour buckets keep a hot run spread out.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    pos = global_position(ev, [F.col("ts"), F.col("event_id")],
                          [F.date_trunc("hour", F.col("ts"))], "iteration", partition=["user_id"])
    return pos.select(
        F.col("user_id").alias("run"), F.col("iteration"), F.col("value").alias("loss"),
        ((F.col("event_id") % 3) / F.lit(2.0)).alias("accuracy"),
        ((F.col("event_id") % 101) / F.lit(100.0)).alias("validation"))
