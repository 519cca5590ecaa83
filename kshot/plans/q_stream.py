"""Streaming queries (K1, K2) drained with availableNow into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators.splits import support_query_split
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_classify import f1_sql
from kshot.plans.registry import register
from kshot.session import shared_dir, staged
from kshot.streaming.stream import (classify_stream_batches, fits_stream, parquet_stream, run_to_parquet, stream_binary_metrics,
                                    stream_classify, utc_day, utc_instant)

SEED = 42


@register("stream_classify", f"""WITH {f1_sql()}
SELECT item_id, actual::BIGINT AS actual, pred::BIGINT AS pred, {S.r('score')} AS score FROM pred""")
def q_stream_classify(spark, sf):
    tagged, labels = support_query_split(fx.items_vec(spark, sf), 1, SEED)
    support = tagged.where("role = 'support'").select("class_idx", "vec")
    sup_ids = tagged.where("role = 'support'").select("item_id")
    stream = parquet_stream(spark, sf, "embeddings", "vec_id bigint, embedding array<float>, label int")
    q = (stream.select(F.col("vec_id").alias("item_id"), F.col("label").alias("class"), F.col("embedding").alias("vec"))
         .join(sup_ids, "item_id", "left_anti")
         .join(labels, "class").select("item_id", F.col("class_idx").alias("actual"), "vec"))
    path = shared_dir(spark, "stream_classify")
    support = staged(support, "support")
    if fits_stream(support):
        run_to_parquet(stream_classify(q, support), path + "/out", path + "/ckpt")
    else:
        classify_stream_batches(q, support, path + "/out", path + "/ckpt")
    res = spark.read.parquet(path + "/out")
    return res.select("item_id", F.col("actual").cast("bigint").alias("actual"),
                      F.col("pred").cast("bigint").alias("pred"), (F.round("score", 6) + F.lit(0.0)).alias("score"))


@register("stream_binary_metrics", f"""WITH s AS (SELECT ts, CASE WHEN value > 5 THEN 1 ELSE 0 END AS pred,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS actual FROM events),
w AS (SELECT date_trunc('day', ts) AS ws, count(*) AS n, sum(CASE WHEN pred = actual THEN 1 ELSE 0 END) AS correct,
  sum(CASE WHEN pred = 1 AND actual = 1 THEN 1 ELSE 0 END) AS tp, sum(pred) AS pp, sum(actual) AS ap FROM s GROUP BY 1),
m AS (SELECT ws, n, correct / n AS accuracy, CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS recall,
  CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision FROM w)
SELECT strftime(ws, '%Y-%m-%d') AS window_start, n, {S.r('accuracy')} AS accuracy, {S.r('recall')} AS recall,
  {S.r('precision')} AS precision,
  {S.r('CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END')} AS f_beta
FROM m WHERE ws + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_binary_metrics(spark, sf):
    stream = parquet_stream(spark, sf, "events", "event_id bigint, ts timestamp_ntz, user_id bigint, "
                                                 "event_type string, value double, props string")
    scored = stream.select(utc_instant(F.col("ts"), spark).alias("ts"), (F.col("value") > 5).cast("int").alias("pred"),
                           F.col("event_type").isin("purchase", "signup").cast("int").alias("actual"))
    m = stream_binary_metrics(scored, "1 day", "1 hour")
    out = m.select(utc_day(F.col("window_start")).alias("window_start"), "n",
                   *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])
    path = shared_dir(spark, "stream_binary_metrics")
    run_to_parquet(out, path + "/out", path + "/ckpt")
    return spark.read.parquet(path + "/out")
