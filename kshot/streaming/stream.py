"""Streaming nearest-support classification (K1) and windowed binary metrics (K2).

K1 keeps the top-1 row-local: a support set under the byte bound goes to every task as a matrix (or, for a scorer
without a block kernel, as one broadcast ``array<struct>`` row), so the stream-static comparison needs no state and
runs in append mode; above the bound micro-batches are classified in batch mode.  K2 is a watermarked event-time window
aggregation; a window is emitted once the watermark passes its end (late rows are dropped).
Sinks are parquet files in the shared folder with a checkpoint location (exactly-once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kshot.functions.vectors import manhattan_similarity
from kshot.operators.classify import Scorer, _best_in, nearest_support
from kshot.operators.metrics import f_beta_expr
from kshot.operators.nearest import KERNELS, MAX_BYTES, nearest_in_blocks, vector_bytes, write_support


def parquet_stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """One table as a file stream: a single file or a folder of part files (the glob matches either)."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def utc_instant(ntz: Column, spark: SparkSession) -> Column:
    """The instant whose UTC wall clock equals a ``timestamp_ntz`` value, whatever the session zone."""
    return F.from_utc_timestamp(ntz.cast("timestamp"), spark.conf.get("spark.sql.session.timeZone"))


def utc_day(ts: Column) -> Column:
    """``yyyy-MM-dd`` of an instant in UTC (from epoch seconds, independent of the session zone)."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int")).cast("string")


def fits_stream(support: DataFrame, max_bytes: int = MAX_BYTES, vec: str = "vec") -> bool:
    """Whether ``stream_classify`` takes the support set; else ``classify_stream_batches`` does."""
    return vector_bytes(support, vec) <= max_bytes


def stream_classify(queries: DataFrame, support: DataFrame, score: Scorer = manhattan_similarity,
                    query_vec: str = "vec", max_bytes: int = MAX_BYTES) -> DataFrame:
    """K1: streaming queries x static support -> ``pred``, ``score`` per query row (no state)."""
    sup = write_support(support)
    if not fits_stream(sup, max_bytes):
        raise ValueError("support set above the byte bound; use classify_stream_batches")
    if score in KERNELS:
        return nearest_in_blocks(queries, sup, KERNELS[score], query_vec, max_bytes)
    packed = sup.agg(F.array_sort(F.collect_list(F.struct("class_idx", "vec"))).alias("_sup"))
    best = _best_in(F.col("_sup"), F.col(query_vec), score)
    return (queries.crossJoin(F.broadcast(packed)).withColumn("_best", best)
            .select(*queries.columns, F.col("_best.class_idx").alias("pred"), F.col("_best.sim").alias("score")))


def stream_binary_metrics(scored: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                          beta: float = 1.0, positive: int = 1) -> DataFrame:
    """K2: per event-time window ``(window_start, n, accuracy, recall, precision, f_beta)``."""
    pos = F.lit(positive)
    agg = (scored.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
           .agg(F.count(F.lit(1)).alias("n"),
                F.sum((F.col("pred") == F.col("actual")).cast("long")).alias("correct"),
                F.sum(((F.col("pred") == pos) & (F.col("actual") == pos)).cast("long")).alias("tp"),
                F.sum((F.col("pred") == pos).cast("long")).alias("pp"),
                F.sum((F.col("actual") == pos).cast("long")).alias("ap")))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    p, r = ratio("tp", "pp"), ratio("tp", "ap")
    return agg.select(F.col("w.start").alias("window_start"), "n", ratio("correct", "n").alias("accuracy"),
                      r.alias("recall"), p.alias("precision"), f_beta_expr(p, r, beta).alias("f_beta"))


def classify_stream_batches(queries: DataFrame, support: DataFrame, path: str, checkpoint: str,
                            score: Scorer = manhattan_similarity, query_key: str = "item_id",
                            max_broadcast_rows: int | None = None) -> None:
    """K1 for any support size: every micro-batch is classified with the batch operator (broadcast or
    chunked, salted path) and written to ``path/batch_id=<id>`` with overwrite, so a replayed batch
    replaces its own output (exactly-once effect with the checkpointed source offsets)."""
    def per_batch(df: DataFrame, batch_id: int) -> None:
        out = nearest_support(df, support, score, query_key=query_key, max_broadcast_rows=max_broadcast_rows)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    q = (queries.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream with ``availableNow`` into parquet (file sink + checkpoint = exactly-once)."""
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
