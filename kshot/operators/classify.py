"""Nearest-support classification and one-shot scoring.

The support set (C classes x k shots) is the only thing compared with every query; no query x support rows are made.
Manhattan and cosine run in block kernels (``operators.nearest``).  Any other scorer is a ``(Column, Column) -> Column``
expression: a support set under ``max_bytes`` travels as one broadcast ``array<struct>`` row and the argmax is a row-local
``aggregate``; a larger one is cut by hash into chunks of that size, queries meet chunks through a salted equi-join, the
best per chunk is kept row-locally and a partial ``max_by`` per query finishes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kshot.functions.vectors import manhattan_similarity
from kshot.operators.nearest import KERNELS, MAX_BYTES, nearest_in_blocks, row_bytes, vector_bytes, write_support
from kshot.session import staged

Scorer = Callable[[Column, Column], Column]

NEG_INF = float("-inf")


def _best_in(arr: Column, qvec: Column, score: Scorer) -> Column:
    """Row-local argmax over an ``array<struct<class_idx, vec>>`` sorted by class_idx.

    Returns ``struct(sim, class_idx)``; the lowest class index wins a tie.
    """
    scored = F.transform(arr, lambda s: F.struct(
        F.coalesce(score(qvec, s["vec"]), F.lit(NEG_INF)).alias("sim"), s["class_idx"].alias("class_idx")))
    init = F.struct(F.lit(None).cast("double").alias("sim"), F.lit(None).cast("int").alias("class_idx"))
    return F.aggregate(scored, init, lambda acc, s: F.when(
        acc["class_idx"].isNull() | (s["sim"] > acc["sim"]), s).otherwise(acc))


def nearest_support(queries: DataFrame, support: DataFrame, score: Scorer = manhattan_similarity,
                    query_vec: str = "vec", support_vec: str = "vec", query_key: str = "item_id",
                    max_broadcast_rows: int | None = None, queries_per_task: int = 200_000,
                    max_bytes: int = MAX_BYTES, counted: bool = False) -> DataFrame:
    """D11 + F1: add ``pred`` (class index of the most similar support) and ``score`` to ``queries``.

    The support rows (classes x shots, far fewer than items) are written once, so the size check and the comparison read
    them without recomputing the item pass.  They go to every task only under ``max_bytes`` of vectors (and
    ``max_broadcast_rows`` rows, where given).  ``counted`` adds ``compared``, the number of supports a query was compared
    with (block kernels only).
    """
    sup = write_support(support, support_vec)
    if max_broadcast_rows is not None:
        max_bytes = min(max_bytes, max_broadcast_rows * row_bytes(sup, "vec"))
    if score in KERNELS:
        return nearest_in_blocks(queries, sup, KERNELS[score], query_vec, max_bytes, counted, queries_per_task)
    size, qv = vector_bytes(sup, "vec"), F.col(query_vec)
    packed = F.array_sort(F.collect_list(F.struct("class_idx", "vec"))).alias("_sup")
    if size <= max_bytes:
        return (queries.crossJoin(F.broadcast(sup.agg(packed)))
                .withColumn("_best", _best_in(F.col("_sup"), qv, score))
                .select(*queries.columns, F.col("_best.class_idx").alias("pred"), F.col("_best.sim").alias("score")))
    n_chunks = -(-size // max_bytes)
    chunks = sup.groupBy(F.pmod(F.xxhash64("class_idx", "vec"), F.lit(n_chunks)).cast("int").alias("chunk")).agg(packed)
    kept = staged(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    salts = max(1, -(-kept.count() // queries_per_task))
    q = (kept.select("_row", qv.alias("_vec"), F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("_salt"))
         .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))))
    c = chunks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    local = (q.join(c, ["chunk", "_salt"]).withColumn("_best", _best_in(F.col("_sup"), F.col("_vec"), score))
             .select("_row", F.col("_best.sim").alias("sim"), F.col("_best.class_idx").alias("cidx")))
    best = local.groupBy("_row").agg(F.max(F.struct("sim", (-F.col("cidx")).alias("minus"))).alias("_b"))
    return kept.join(best, "_row").select(*queries.columns, (-F.col("_b.minus")).alias("pred"), F.col("_b.sim").alias("score"))


def nearest_support_pairs(pairs: DataFrame, query_key: str = "query", sim: str = "sim") -> DataFrame:
    """F1 on already scored ``(query, class_idx, sim)`` rows: partial ``max_by`` per query."""
    return pairs.groupBy(query_key).agg(
        F.max_by(F.col("class_idx"), F.struct(F.coalesce(F.col(sim), F.lit(NEG_INF)),
                                              -F.col("class_idx"))).alias("pred"))


def query_support_cross(queries: DataFrame, support: DataFrame, max_broadcast_rows: int = 200_000,
                        query_key: str = "query", queries_per_task: int = 200_000) -> DataFrame:
    """D11 as rows: every query beside every support row (the output is queries x support by definition).

    The support is broadcast under a checked row bound; above it, support rows are numbered into
    chunks of the bound's size and queries meet every chunk through a salted equi-join, so no join
    key carries all queries.
    """
    n_sup = support.limit(max_broadcast_rows + 1).count()
    if n_sup <= max_broadcast_rows:
        return queries.crossJoin(F.broadcast(support))
    sup = support.withColumn("_chunk", F.pmod(F.xxhash64(*support.columns), F.lit(max(1, -(-support.count()
                                                                                     // max_broadcast_rows)))))
    n_chunks = max(1, -(-support.count() // max_broadcast_rows))
    salts = max(1, -(-queries.count() // queries_per_task))
    q = (queries.withColumn("_salt", F.pmod(F.xxhash64(F.col(query_key)), F.lit(salts)))
         .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))))
    sup = sup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return q.join(sup, ["_chunk", "_salt"]).drop("_chunk", "_salt")


def one_shot_hit(scored: DataFrame, task_cols: list[str], pair_col: str = "pair_no", p: str = "p",
                 min_std: float = 0.01, digits: int = 9) -> DataFrame:
    """F2: per task, hit = pair 0 holds the max score (first index wins ties) and std_pop(p) > min_std."""
    rp = F.round(F.col(p), digits)
    return scored.groupBy(*task_cols).agg(
        ((F.max_by(F.col(pair_col), F.struct(rp, -F.col(pair_col))) == 0)
         & (F.stddev_pop(F.col(p)) > F.lit(min_std))).cast("int").alias("hit"))


def accuracy_by_superclass(hits: DataFrame, superclass: str = "superclass", hit: str = "hit") -> DataFrame:
    """mean hit per superclass plus the total row (``is_total`` = 1, superclass null)."""
    return (hits.rollup(superclass)
            .agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("tasks"),
                 F.grouping(superclass).cast("int").alias("is_total")))


def one_shot_accuracy(hits: DataFrame, hit: str = "hit") -> DataFrame:
    """F4."""
    return hits.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("tasks"))


def predict_pairs(p: Column, threshold: float = 0.5) -> Column:
    """F6."""
    return (p > F.lit(threshold)).cast("int")


