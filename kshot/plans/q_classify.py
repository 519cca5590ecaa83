"""Queries: support/query split, nearest support, classification metrics (C6, B15, D11, F1, F5, G*, L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.functions.vectors import cosine_similarity, manhattan_similarity
from kshot.operators import metrics as M
from kshot.operators.labels import label_index
from kshot.operators.splits import support_query_split
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.evaluate import classify, classify_and_score
from kshot.plans.registry import register

SEED = 42


def _r(c, d=6):
    return F.round(c, d) + F.lit(0.0)


def f1_sql(seed=SEED, k=1, score=S.manhattan, max_cte=True) -> str:
    """CTEs items, mi, lab, t, sup, q, sims, pred (query item_id, true, pred, score)."""
    return f"""{S.ITEMS_VEC},
{S.member_cte(seed)},
{S.label_cte()},
t AS (SELECT mi.*, lab.class_idx FROM mi JOIN lab USING (class)),
sup AS (SELECT class_idx, vec FROM t WHERE member_idx < {k}),
q AS (SELECT item_id, class_idx AS actual, vec FROM t WHERE member_idx >= {k}),
sims AS (SELECT q.item_id, q.actual, sup.class_idx,
    coalesce({score('q.vec', 'sup.vec')}, '-inf'::DOUBLE) AS sim,
    coalesce({'-' + S.l1('q.vec', 'sup.vec') if score is S.manhattan else score('q.vec', 'sup.vec')}, '-inf'::DOUBLE) AS rank
    FROM q CROSS JOIN sup),
pred AS (SELECT item_id, any_value(actual) AS actual, first(class_idx ORDER BY rank DESC, class_idx) AS pred,
    first(sim ORDER BY rank DESC, class_idx) AS score FROM sims GROUP BY item_id)"""


# ---------------------------------------------------------------- F5 flagship
@register("classify_and_score", f"""WITH {f1_sql()},
labels AS (SELECT class_idx AS label FROM lab),
{S.metrics_ctes('pred', 'labels')}
SELECT {S.r('accuracy')} AS accuracy, {S.r('recall')} AS recall, {S.r('precision')} AS precision,
       {S.r('f_beta')} AS f_beta FROM mm""")
def q_classify_and_score(spark, sf):
    m = classify_and_score(fx.items_vec(spark, sf), k=1, seed=SEED)
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])


@register("support_query_split", f"""WITH {S.ITEMS_VEC}, {S.member_cte(SEED)}, {S.label_cte()}
SELECT item_id, class, class_idx::BIGINT AS class_idx, member_idx::BIGINT AS member_idx,
       CASE WHEN member_idx < 1 THEN 'support' ELSE 'query' END AS role
FROM mi JOIN lab USING (class)""")
def q_support_query_split(spark, sf):
    tagged, _ = support_query_split(fx.items_vec(spark, sf), 1, SEED)
    return tagged.select("item_id", "class", "class_idx", "member_idx", "role")


@register("label_index", f"""WITH {S.ITEMS_TEXT}, {S.label_cte()} SELECT class, class_idx::BIGINT AS class_idx FROM lab""")
def q_label_index(spark, sf):
    return label_index(fx.items_text(spark, sf))


@register("nearest_support", f"""WITH {f1_sql()}
SELECT item_id, actual::BIGINT AS actual, pred::BIGINT AS pred, {S.r('score')} AS score FROM pred""")
def q_nearest_support(spark, sf):
    pred, _ = classify(fx.items_vec(spark, sf), 1, SEED)
    return pred.select("item_id", F.col("actual").cast("bigint").alias("actual"),
                       F.col("pred").cast("bigint").alias("pred"), _r(F.col("score")).alias("score"))


@register("nearest_support_chunked", f"""WITH {f1_sql()}
SELECT item_id, actual::BIGINT AS actual, pred::BIGINT AS pred, {S.r('score')} AS score FROM pred""")
def q_nearest_support_chunked(spark, sf):
    """Same as nearest_support with a support bound of 3 rows, forcing the chunked, salted path."""
    pred, _ = classify(fx.items_vec(spark, sf), 1, SEED, max_broadcast_rows=3)
    return pred.select("item_id", F.col("actual").cast("bigint").alias("actual"),
                       F.col("pred").cast("bigint").alias("pred"), _r(F.col("score")).alias("score"))


FAR = 50.0


@register("nearest_support_far", f"""WITH {S.ITEMS_VEC.replace("embedding AS vec", f"list_transform(embedding, lambda x: (x * {FAR})::FLOAT) AS vec")},
{f1_sql().split(S.ITEMS_VEC + ",", 1)[1]}
SELECT item_id, actual::BIGINT AS actual, pred::BIGINT AS pred FROM pred""")
def q_nearest_support_far(spark, sf):
    """Nearest support on vectors scaled so far apart that every similarity rounds to 0."""
    items = fx.items_vec(spark, sf).withColumn("vec", F.transform("vec", lambda x: (x * F.lit(FAR)).cast("float")))
    pred, _ = classify(items, 1, SEED)
    return pred.select("item_id", F.col("actual").cast("bigint").alias("actual"), F.col("pred").cast("bigint").alias("pred"))


@register("classify_cosine", f"""WITH {f1_sql(score=S.cosine)},
labels AS (SELECT class_idx AS label FROM lab),
{S.metrics_ctes('pred', 'labels')}
SELECT {S.r('accuracy')} AS accuracy, {S.r('recall')} AS recall, {S.r('precision')} AS precision,
       {S.r('f_beta')} AS f_beta FROM mm""")
def q_classify_cosine(spark, sf):
    """L1: the scorer is a plug-in ``(Column, Column) -> Column``; here cosine similarity."""
    m = classify_and_score(fx.items_vec(spark, sf), k=1, seed=SEED, score=cosine_similarity)
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])


# ---------------------------------------------------------------- G7-G10 on F1 output
def _multi(spark, sf, beta=1.0):
    pred, labels = classify(fx.items_vec(spark, sf), 1, SEED)
    return M.multi_metrics(pred, labels, "pred", "actual", beta, label_col="class_idx")


def _multi_sql(col: str, beta=1.0) -> str:
    return f"""WITH {f1_sql()},
labels AS (SELECT class_idx AS label FROM lab),
{S.metrics_ctes('pred', 'labels', beta)}
SELECT {S.r(col)} AS {col} FROM mm"""


@register("multi_precision", _multi_sql("precision"))
def q_multi_precision(spark, sf):
    return _multi(spark, sf).select(_r(F.col("precision")).alias("precision"))


@register("multi_recall", _multi_sql("recall"))
def q_multi_recall(spark, sf):
    return _multi(spark, sf).select(_r(F.col("recall")).alias("recall"))


@register("multi_f_beta", _multi_sql("f_beta", 2.0))
def q_multi_f_beta(spark, sf):
    return _multi(spark, sf, 2.0).select(_r(F.col("f_beta")).alias("f_beta"))


@register("multi_metrics", f"""WITH {f1_sql()},
labels AS (SELECT class_idx AS label FROM lab),
{S.metrics_ctes('pred', 'labels')}
SELECT {S.r('accuracy')} AS accuracy, {S.r('recall')} AS recall, {S.r('precision')} AS precision,
       {S.r('f_beta')} AS f_beta FROM mm""")
def q_multi_metrics(spark, sf):
    m = _multi(spark, sf)
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])


# ---------------------------------------------------------------- G1-G6, L2 on labels
BIN = "b AS (SELECT doc_id, quality AS pred, toxic AS actual FROM labels)"


@register("mean_or_zero", f"SELECT {S.r('coalesce(avg(quality), 0.0)')} AS mean FROM labels")
def q_mean_or_zero(spark, sf):
    return M.mean_or_zero(fx.table(spark, sf, "labels"), "quality").select(_r(F.col("mean")).alias("mean"))


def _bin_sql(cols: list[str], beta=1.0, positive=1) -> str:
    return f"WITH {BIN}, {S.binary_ctes('b', beta, positive)} SELECT " + ", ".join(
        f"{S.r(c)} AS {c}" for c in cols) + " FROM bm"


@register("accuracy", _bin_sql(["accuracy"]))
def q_accuracy(spark, sf):
    return M.accuracy(fx.binary(spark, sf)).select(_r(F.col("accuracy")).alias("accuracy"))


@register("binary_precision", _bin_sql(["precision"]))
def q_binary_precision(spark, sf):
    return M.binary_precision(fx.binary(spark, sf)).select(_r(F.col("precision")).alias("precision"))


@register("binary_recall", _bin_sql(["recall"], positive=0))
def q_binary_recall(spark, sf):
    return M.binary_recall(fx.binary(spark, sf), positive=0).select(_r(F.col("recall")).alias("recall"))


@register("binary_f_beta", _bin_sql(["f_beta"], beta=2.0))
def q_binary_f_beta(spark, sf):
    return M.binary_f_beta(fx.binary(spark, sf), beta=2.0).select(_r(F.col("f_beta")).alias("f_beta"))


@register("binary_metrics", _bin_sql(["accuracy", "recall", "precision", "f_beta"]))
def q_binary_metrics(spark, sf):
    m = M.binary_metrics(fx.binary(spark, sf))
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])


@register("metric_selection", f"""WITH {BIN}, {S.binary_ctes('b')}
SELECT 'precision' AS metric, {S.r('precision')} AS value FROM bm
UNION ALL SELECT 'f_beta', {S.r('f_beta')} FROM bm
UNION ALL SELECT 'accuracy', {S.r('accuracy')} FROM bm""")
def q_metric_selection(spark, sf):
    m = M.select_metrics(fx.binary(spark, sf), ["precision", "f_beta", "accuracy"])
    return m.select("metric", _r(F.col("value")).alias("value"))


# ---------------------------------------------------------------- L1 scorer plug-in
_W = [((j % 7) - 3) / 10.0 for j in range(64)]
_B0 = 0.1


def _wl1_sql(a: str, b: str) -> str:
    return (f"(1.0 / (1.0 + exp(-({_B0} + list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: abs({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ((((i - 1) % 7) - 3) / 10.0)))))))")


@register("scorer_plugin", f"""WITH {f1_sql(score=_wl1_sql)},
labels AS (SELECT class_idx AS label FROM lab),
{S.metrics_ctes('pred', 'labels')}
SELECT {S.r('accuracy')} AS accuracy, {S.r('recall')} AS recall, {S.r('precision')} AS precision,
       {S.r('f_beta')} AS f_beta FROM mm""")
def q_scorer_plugin(spark, sf):
    """L1: any ``(Column, Column) -> Column`` scorer plugs into classification; here sigmoid(w.|a-b| + b0)."""
    from kshot.functions.vectors import weighted_l1_probability
    m = classify_and_score(fx.items_vec(spark, sf), k=1, seed=SEED,
                           score=lambda a, b: weighted_l1_probability(a, b, _W, _B0))
    return m.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "recall", "precision", "f_beta")])
