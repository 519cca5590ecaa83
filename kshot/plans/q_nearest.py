"""Queries: exact nearest support with a class per item (F1 with very many classes), pair scores in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.functions import blocks as BK
from kshot.operators import splits as C
from kshot.operators.classify import nearest_support
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_vectors import KEYS, KS, VP, vec_pairs
from kshot.plans.registry import register

# items of the background classes are supports, each a class of its own; items of the evaluation classes are queries
_MANY = f"""WITH {S.ITEMS_VEC}, c AS (SELECT DISTINCT class FROM items),
r AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(11, '@class')}, class) AS rk, count(*) OVER () AS cc FROM c),
i AS (SELECT item_id, vec, rk <= floor(cc * 0.6) AS background FROM items JOIN r USING (class)),
d AS (SELECT q.item_id, s.item_id AS support, {S.l1('q.vec', 's.vec')} AS d
      FROM i q JOIN i s ON s.background AND NOT q.background),
n AS (SELECT item_id, support, d, row_number() OVER (PARTITION BY item_id ORDER BY d, support) AS k FROM d)
SELECT item_id, support AS pred, {S.r('exp(-d)', 9)} AS score FROM n WHERE k = 1"""


def _many(spark, sf):
    items = C.background_evaluation(fx.items_vec(spark, sf), 0.6, 11).select("item_id", "vec", "split")
    support = items.where("split = 'background'").select(F.col("item_id").alias("class_idx"), "vec")
    return items.where("split = 'evaluation'").select("item_id", "vec"), support


def _answer(found):
    return found.select("item_id", F.col("pred").cast("bigint").alias("pred"), (F.round("score", 9) + F.lit(0.0)).alias("score"))


@register("nearest_support_many", _MANY)
def q_nearest_support_many(spark, sf):
    return _answer(nearest_support(*_many(spark, sf)))


@register("nearest_support_many_chunked", _MANY)
def q_nearest_support_many_chunked(spark, sf):
    """The same with supports above the byte bound: chunks by pivot cell, queries sent where their bound reaches."""
    return _answer(nearest_support(*_many(spark, sf), max_bytes=16_384))


@register("nearest_support_work")
def q_nearest_support_work(spark, sf):
    """How many of all (query, support) distances each way computes."""
    queries, support = _many(spark, sf)
    n = support.agg(F.count(F.lit(1)).alias("supports"))
    out = None
    for way, bound in (("in every task", 32 << 20), ("in chunks", 16_384)):
        w = nearest_support(queries, support, counted=True, max_bytes=bound).agg(
            F.count(F.lit(1)).alias("queries"), F.sum("compared").alias("compared")).crossJoin(F.broadcast(n))
        w = w.select(F.lit(way).alias("way"), "queries", "supports", "compared",
                     F.round(F.col("compared") / (F.col("queries") * F.col("supports")), 6).alias("share"))
        out = w if out is None else out.unionByName(w)
    return out


@register("manhattan_similarity_blocks", f"WITH {VP} SELECT {KS}, {S.r(S.manhattan('va', 'vb'), 9)} AS sim FROM vp")
def q_manhattan_similarity_blocks(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, (F.round(BK.manhattan_similarity_blocks(F.col("va"), F.col("vb")), 9) + F.lit(0.0)).alias("sim"))


@register("cosine_similarity_blocks", f"WITH {VP} SELECT {KS}, {S.r(S.cosine('va', 'vb'), 9)} AS sim FROM vp")
def q_cosine_similarity_blocks(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, (F.round(BK.cosine_similarity_blocks(F.col("va"), F.col("vb")), 9) + F.lit(0.0)).alias("sim"))
