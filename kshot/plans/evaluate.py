"""end-to-end few-shot evaluation (C6 -> D11 -> score -> F1 -> multi-class metrics); text pairs end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.functions.vectors import cosine_similarity, manhattan_similarity
from kshot.operators import embedding as EM
from kshot.operators import text as B
from kshot.operators.classify import Scorer, nearest_support, predict_pairs
from kshot.operators.metrics import multi_metrics
from kshot.operators.splits import draw_support
from kshot.session import staged


def classify(items: DataFrame, k: int = 1, seed=42, score: Scorer = manhattan_similarity,
             max_broadcast_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Predicted class index for every query item; returns ``(predictions, labels)``."""
    support, queries, labels = draw_support(items, k, seed)
    queries = queries.select("item_id", F.col("class_idx").alias("actual"), "vec")
    pred = nearest_support(queries, support.select("class_idx", "vec"), score, max_broadcast_rows=max_broadcast_rows)
    return pred.select("item_id", "actual", "pred", "score"), labels


def classify_and_score(items: DataFrame, k: int = 1, seed=42, score: Scorer = manhattan_similarity,
                       beta: float = 1.0, max_broadcast_rows: int | None = None) -> DataFrame:
    """One row ``(accuracy, recall, precision, f_beta)`` (macro over all classes)."""
    pred, labels = classify(items, k, seed, score, max_broadcast_rows)
    return multi_metrics(pred, labels, "pred", "actual", beta, label_col="class_idx")


def score_pairs(pairs: DataFrame, docs: DataFrame, vocab: DataFrame, matrix: DataFrame, dim: int, length: int = 100,
                score: Scorer = cosine_similarity, threshold: float = 0.5) -> DataFrame:
    """Text pairs end to end: encode, pad, look up and pool vectors, score and predict.

    ``pairs(a, b, ...)`` of ``docs(item_id, tokens)`` gain ``p`` (0 where the score is undefined) and ``pred``.  Every
    document of the pairs is encoded once, whatever the number of its pairs.
    """
    used = pairs.select(F.explode(F.array("a", "b")).alias("item_id")).distinct()
    enc = B.encode_unk(docs.join(used, "item_id", "left_semi"), vocab, max_len=length)
    enc = enc.select("item_id", B.pad_post_trunc_tail(F.col("ids"), length).alias("ids"))
    vec = staged(EM.max_pool_time(enc, matrix, dim), "pooled")
    side = [vec.select(F.col("item_id").alias(c), F.col("vector").alias(f"_{c}")) for c in ("a", "b")]
    p = F.coalesce(score(F.col("_a"), F.col("_b")), F.lit(0.0))
    return (pairs.join(side[0], "a").join(side[1], "b")
            .select(*pairs.columns, p.alias("p")).withColumn("pred", predict_pairs(F.col("p"), threshold)))
