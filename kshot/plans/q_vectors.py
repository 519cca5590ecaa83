"""Queries: vector tables and pooling (B17-B21, B23, B24), pair scores and losses (E1-E11),
one-shot scoring (F2-F4, F6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.functions import vectors as V
from kshot.operators import classify as K
from kshot.operators import embedding as EM
from kshot.operators import sampling as D
from kshot.operators import scoring as SC
from kshot.operators import splits as C
from kshot.operators import text as B
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_sampling import _d8_sql, _d9_sql, d1_ctes
from kshot.plans.q_text import TVEC_SQL, _vocab_freq, docs, token_vectors
from kshot.plans.registry import register

SEED = 42
DIM = 64
W = [((j % 7) - 3) / 10.0 for j in range(DIM)]
B0 = 0.1


def _r(c, d=6):
    return F.round(c, d) + F.lit(0.0)


def _rv(c, d=6):
    return F.transform(c, lambda x: F.round(x.cast("double"), d) + F.lit(0.0))


def _srv(c: str, d: int = 6) -> str:
    return f"list_transform({c}, lambda x: (round(x::DOUBLE, {d}) + 0.0))"


# ---------------------------------------------------------------- matrices
@register("embedding_matrix_uniform", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {TVEC_SQL},
vv AS (SELECT count(*) AS VV FROM vocab)
SELECT v.id::INTEGER AS id, CASE WHEN v.id = 0 THEN {S.zeros(DIM).replace('lambda x: 0', 'lambda x: 0.0')}
  WHEN t.vector IS NOT NULL THEN {_srv('t.vector')}
  ELSE list_transform(range(1, {DIM} + 1), lambda j: (round((2.0 * {S.unif(7, '@v.id', '@j')} - 1) / sqrt(vv.VV - 1), 6) + 0.0))
  END AS vector
FROM vocab v LEFT JOIN tvec t USING (token), vv""")
def q_embedding_matrix_uniform(spark, sf):
    vocab = _vocab_freq(spark, sf).select("token", "id")
    m = EM.embedding_matrix_uniform(vocab, token_vectors(spark, sf, vocab), DIM, 7)
    return m.select("id", _rv(F.col("vector")).alias("vector"))


_ZM = f"""{S.DTOK}, {S.vocab_freq_cte(2)}, {TVEC_SQL},
zm AS (SELECT v.id::INTEGER AS id, CASE WHEN v.id <> 0 AND t.vector IS NOT NULL THEN list_transform(t.vector, lambda x: x::DOUBLE)
       ELSE {S.zeros(DIM).replace('lambda x: 0', 'lambda x: 0.0')} END AS vector FROM vocab v LEFT JOIN tvec t USING (token))"""


def _zero_matrix(spark, sf):
    vocab = _vocab_freq(spark, sf).select("token", "id")
    return vocab, EM.embedding_matrix_zero(vocab, token_vectors(spark, sf, vocab), DIM)


@register("embedding_matrix_zero", f"WITH {_ZM} SELECT id, {_srv('vector')} AS vector FROM zm")
def q_embedding_matrix_zero(spark, sf):
    _, m = _zero_matrix(spark, sf)
    return m.select("id", _rv(F.col("vector")).alias("vector"))


@register("embedding_lookup", f"""WITH {_ZM}, {S.encode_cte('dtok', 'vocab', 1)},
ex AS (SELECT item_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM enc),
lk AS (SELECT ex.item_id, ex.pos, {_srv('zm.vector')} AS v FROM ex JOIN zm USING (id))
SELECT item_id, count(*) AS n, arg_min(v, pos) AS first, arg_max(v, pos) AS last,
  md5(string_agg(md5(array_to_string(list_transform(v, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',')), '|' ORDER BY pos)) AS digest
FROM lk GROUP BY item_id""")
def q_embedding_lookup(spark, sf):
    """The vectors of every token of every document: their number, the first, the last, and a digest over the vectors of
    all positions in order.  The digest of a vector is made once a row of the matrix and looked up beside it."""
    vocab, m = _zero_matrix(spark, sf)
    mark = F.md5(F.array_join(F.transform("vector", lambda x: F.round(
        F.round(x.cast("double"), 6) * 1000000).cast("bigint").cast("string")), ","))
    out = EM.embedding_lookup(B.encode_unk(docs(spark, sf), vocab), m.withColumn("mark", mark))
    return out.select("item_id", F.size("vectors").cast("long").alias("n"), _rv(F.element_at("vectors", 1)).alias("first"),
                      _rv(F.element_at("vectors", -1)).alias("last"), F.md5(F.array_join("mark", "|")).alias("digest"))


@register("max_pool_time", f"""WITH {_ZM}, {S.encode_cte('dtok', 'vocab', 1)},
ex AS (SELECT item_id, unnest(ids) AS id FROM enc),
el AS (SELECT ex.item_id, unnest(zm.vector) AS x, generate_subscripts(zm.vector, 1) AS d FROM ex JOIN zm USING (id)),
mx AS (SELECT item_id, d, max(x) AS x FROM el GROUP BY item_id, d)
SELECT item_id, list((round(x, 6) + 0.0) ORDER BY d) AS vector FROM mx GROUP BY item_id""")
def q_max_pool_time(spark, sf):
    vocab, m = _zero_matrix(spark, sf)
    enc = B.encode_unk(docs(spark, sf), vocab)
    return EM.max_pool_time(enc, m, DIM).select("item_id", _rv(F.col("vector")).alias("vector"))


@register("last_step", f"""WITH {_ZM}, {S.encode_cte('dtok', 'vocab', 1)}
SELECT enc.item_id, {_srv('zm.vector')} AS vector FROM enc JOIN zm ON zm.id = enc.ids[len(enc.ids)]""")
def q_last_step(spark, sf):
    vocab, m = _zero_matrix(spark, sf)
    enc = B.encode_unk(docs(spark, sf), vocab)
    return EM.last_step(enc, m).select("item_id", _rv(F.col("vector")).alias("vector"))


@register("standardize_vector", f"""WITH m AS (SELECT vec_id, embedding AS v, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS mu FROM embeddings),
s AS (SELECT vec_id, v, mu, sqrt(list_sum(list_transform(v, lambda x: (x::DOUBLE - mu) * (x::DOUBLE - mu))) / len(v)) AS sd FROM m)
SELECT vec_id AS item_id, list_transform(v, lambda x: (round(x::DOUBLE / sd - mu, 6) + 0.0)) AS vector FROM s""")
def q_standardize_vector(spark, sf):
    it = fx.items_vec(spark, sf)
    return it.select("item_id", _rv(V.standardize_vector(F.col("vec"))).alias("vector"))


@register("reshape_grid", """SELECT vec_id AS item_id,
  list_transform(range(8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]) AS grid FROM embeddings""")
def q_reshape_grid(spark, sf):
    it = fx.items_vec(spark, sf)
    return it.select("item_id", V.reshape_grid(F.col("vec"), 8, 8).alias("grid"))


# ---------------------------------------------------------------- pair scores
VP = f"""{d1_ctes(S.ITEMS_VEC)},
vp AS (SELECT d1.class, d1.round, d1.pair_no, d1.label, ea.embedding AS va, eb.embedding AS vb
       FROM d1 JOIN embeddings ea ON ea.vec_id = d1.a JOIN embeddings eb ON eb.vec_id = d1.b)"""
KEYS = ["class", "round", "pair_no", "label"]
KS = "class, round, pair_no, label"


def vec_pairs(spark, sf):
    it = fx.items_vec(spark, sf)
    pr = D.sample_balanced_pairs(it, 50, SEED)
    va = it.select(F.col("item_id").alias("a"), F.col("vec").alias("va"))
    vb = it.select(F.col("item_id").alias("b"), F.col("vec").alias("vb"))
    return pr.join(va, "a").join(vb, "b")


@register("abs_diff", f"""WITH {VP} SELECT {KS},
  list_transform(range(1, len(va) + 1), lambda i: (round(abs(va[i]::DOUBLE - vb[i]::DOUBLE), 6) + 0.0)) AS diff FROM vp""")
def q_abs_diff(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, _rv(V.abs_diff(F.col("va"), F.col("vb"))).alias("diff"))


@register("manhattan_similarity", f"WITH {VP} SELECT {KS}, {S.r(S.manhattan('va', 'vb'), 9)} AS sim FROM vp")
def q_manhattan_similarity(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, _r(V.manhattan_similarity(F.col("va"), F.col("vb")), 9).alias("sim"))


@register("threshold_match", f"""WITH {VP} SELECT {KS},
  CASE WHEN {S.cosine('va', 'vb')} >= 0.5 THEN 1 ELSE 0 END AS match FROM vp""")
def q_threshold_match(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, V.threshold_match(V.cosine_similarity(F.col("va"), F.col("vb")), 0.5).alias("match"))


@register("cosine_similarity", f"WITH {VP} SELECT {KS}, {S.r(S.cosine('va', 'vb'), 9)} AS sim FROM vp")
def q_cosine_similarity(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, _r(V.cosine_similarity(F.col("va"), F.col("vb")), 9).alias("sim"))


_EUC = "sqrt(list_sum(list_transform(range(1, len(va) + 1), lambda i: (va[i]::DOUBLE - vb[i]::DOUBLE) * (va[i]::DOUBLE - vb[i]::DOUBLE))))"
_RDIST = f"(CASE WHEN {S.norm('va')} + {S.norm('vb')} > 0 THEN {_EUC} / ({S.norm('va')} + {S.norm('vb')}) END)"


@register("relative_euclidean", f"""WITH {VP} SELECT {KS}, {S.r(_RDIST, 9)} AS dist,
  (1 - round_even({_RDIST}, 0))::INTEGER AS match FROM vp""")
def q_relative_euclidean(spark, sf):
    p = vec_pairs(spark, sf)
    dist, match = V.relative_euclidean(F.col("va"), F.col("vb"))
    return p.select(*KEYS, _r(dist, 9).alias("dist"), match.alias("match"))


@register("concat_features", f"""WITH {VP} SELECT {KS},
  list_concat(list_transform(va, lambda x: x::DOUBLE), list_transform(vb, lambda x: x::DOUBLE)) AS features FROM vp""")
def q_concat_features(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, V.concat_features(F.col("va"), F.col("vb")).alias("features"))


_WSQL = (f"(1.0 / (1.0 + exp(-({B0} + list_sum(list_transform(range(1, len(va) + 1), "
         f"lambda i: abs(va[i]::DOUBLE - vb[i]::DOUBLE) * ((((i - 1) % 7) - 3) / 10.0)))))))")


@register("weighted_l1_probability", f"WITH {VP} SELECT {KS}, {S.r(_WSQL, 9)} AS p FROM vp")
def q_weighted_l1_probability(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, _r(V.weighted_l1_probability(F.col("va"), F.col("vb"), W, B0), 9).alias("p"))


@register("predict_pairs", f"WITH {VP} SELECT {KS}, CASE WHEN {_WSQL} > 0.5 THEN 1 ELSE 0 END AS pred FROM vp")
def q_predict_pairs(spark, sf):
    p = vec_pairs(spark, sf)
    return p.select(*KEYS, K.predict_pairs(V.weighted_l1_probability(F.col("va"), F.col("vb"), W, B0)).alias("pred"))


def _bce_sql(p: str) -> str:
    pc = f"least(greatest({p}, 1e-7), 1 - 1e-7)"
    return f"-(label * ln({pc}) + (1 - label) * ln(1 - {pc}))"


@register("loss_bce_similarity", f"WITH {VP} SELECT {S.r('avg(' + _bce_sql(S.manhattan('va', 'vb')) + ')')} AS loss FROM vp")
def q_loss_bce_similarity(spark, sf):
    p = vec_pairs(spark, sf).withColumn("sim", V.manhattan_similarity(F.col("va"), F.col("vb")))
    return SC.loss_bce_similarity(p).select(_r(F.col("loss")).alias("loss"))


_CC = (f"(label * (1 - {S.cosine('va', 'vb')}) * (1 - {S.cosine('va', 'vb')}) / 4.0 + (1 - label) * "
       f"CASE WHEN {S.cosine('va', 'vb')} > 0.4 THEN {S.cosine('va', 'vb')} * {S.cosine('va', 'vb')} ELSE 0.0 END)")


@register("loss_contrastive_cosine", f"WITH {VP} SELECT {S.r('avg(' + _CC + ')')} AS loss FROM vp")
def q_loss_contrastive_cosine(spark, sf):
    p = vec_pairs(spark, sf).withColumn("sim", V.cosine_similarity(F.col("va"), F.col("vb")))
    return SC.loss_contrastive_cosine(p).select(_r(F.col("loss")).alias("loss"))


_CE = (f"(label * {_RDIST} * {_RDIST} + (1 - label) * greatest(1 - {_RDIST}, 0.0) * greatest(1 - {_RDIST}, 0.0))")


@register("loss_contrastive_euclidean", f"WITH {VP} SELECT {S.r('avg(' + _CE + ')')} AS loss FROM vp")
def q_loss_contrastive_euclidean(spark, sf):
    p = vec_pairs(spark, sf).withColumn("dist", V.relative_euclidean(F.col("va"), F.col("vb"))[0])
    return SC.loss_contrastive_euclidean(p).select(_r(F.col("loss")).alias("loss"))


@register("batch_loss_accuracy", f"""WITH {VP},
sp AS (SELECT *, {_WSQL} AS p, row_number() OVER (ORDER BY md5(concat_ws('|', '42', concat_ws('|', class, round, pair_no))),
       concat_ws('|', class, round, pair_no)) AS pos, count(*) OVER () AS nn FROM vp),
bt AS (SELECT *, (pos - 1) // 32 AS batch_id FROM sp WHERE (pos - 1) // 32 < nn // 32)
SELECT batch_id::BIGINT AS batch_id, {S.r('avg(' + _bce_sql('p') + ')')} AS loss,
  {S.r('avg(CASE WHEN (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = label THEN 1 ELSE 0 END)')} AS accuracy
FROM bt GROUP BY batch_id""")
def q_batch_loss_accuracy(spark, sf):
    p = vec_pairs(spark, sf).withColumn("p", V.weighted_l1_probability(F.col("va"), F.col("vb"), W, B0))
    p = p.withColumn("_key", F.concat_ws("|", "class", "round", "pair_no"))
    b = C.minibatches(C.shuffle(p, SEED, "_key"), 32)
    out = SC.batch_loss_accuracy(b)
    return out.select("batch_id", _r(F.col("loss")).alias("loss"), _r(F.col("accuracy")).alias("accuracy"))


# ---------------------------------------------------------------- one-shot scoring
def _task_scores(spark, sf, n, tasks):
    it = fx.items_vec(spark, sf)
    t = D.one_shot_tasks(it, n, tasks, SEED)
    vq = it.select(F.col("item_id").alias("query"), F.col("vec").alias("vq"))
    vs = it.select(F.col("item_id").alias("support"), F.col("vec").alias("vs"))
    return t.join(vq, "query").join(vs, "support").withColumn("p", V.cosine_similarity(F.col("vq"), F.col("vs")))


def _hits_sql(n, tasks) -> str:
    return f"""{_d9_sql(n=n, tasks=tasks)},
sc AS (SELECT t.task, t.pair_no, {S.cosine('q.embedding', 's.embedding')} AS p FROM tasks t
       JOIN embeddings q ON q.vec_id = t.query JOIN embeddings s ON s.vec_id = t.support),
hits AS (SELECT task, CASE WHEN first(pair_no ORDER BY round(p, 9) DESC, pair_no) = 0 AND stddev_pop(p) > 0.01
         THEN 1 ELSE 0 END AS hit FROM sc GROUP BY task)"""


@register("one_shot_hit", f"WITH {_hits_sql(5, 100)} SELECT task, hit FROM hits")
def q_one_shot_hit(spark, sf):
    return K.one_shot_hit(_task_scores(spark, sf, 5, 100), ["task"])


@register("one_shot_accuracy", f"""WITH {_hits_sql(20, 200)}
SELECT {S.r('coalesce(avg(hit), 0.0)')} AS accuracy, count(*) AS tasks FROM hits""")
def q_one_shot_accuracy(spark, sf):
    h = K.one_shot_hit(_task_scores(spark, sf, 20, 200), ["task"])
    return K.one_shot_accuracy(h).select(_r(F.col("accuracy")).alias("accuracy"), "tasks")


@register("accuracy_by_superclass", f"""WITH {_d8_sql()}, {S.DTOK},
alltasks AS (SELECT superclass, task, 0 AS pair_no, query, positive AS support FROM t2
             UNION ALL SELECT superclass, task, pair_no, query, support FROM ng),
ex AS (SELECT item_id, ('0x' || substr(md5(concat_ws('|', '0', token)), 1, 8))::BIGINT % 64 AS b,
       CASE WHEN ('0x' || substr(md5(concat_ws('|', '0', token)), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS s
       FROM (SELECT item_id, unnest(tokens) AS token FROM dtok)),
g AS (SELECT item_id, b, sum(s) AS v FROM ex GROUP BY item_id, b),
fl AS (SELECT d.item_id, j.j AS b, coalesce(g.v, 0.0) AS v FROM (SELECT DISTINCT item_id FROM ex) d
       CROSS JOIN range(64) j(j) LEFT JOIN g ON g.item_id = d.item_id AND g.b = j.j),
hv AS (SELECT item_id, list(v ORDER BY b) AS vector FROM fl GROUP BY item_id),
sc AS (SELECT a.superclass, a.task, a.pair_no, {S.cosine('q.vector', 's.vector')} AS p FROM alltasks a
       JOIN hv q ON q.item_id = a.query JOIN hv s ON s.item_id = a.support),
hits AS (SELECT superclass, task, CASE WHEN first(pair_no ORDER BY round(p, 9) DESC, pair_no) = 0
         AND stddev_pop(p) > 0.01 THEN 1 ELSE 0 END AS hit FROM sc GROUP BY superclass, task)
SELECT superclass, {S.r('avg(hit)')} AS accuracy, count(*) AS tasks, grouping(superclass)::INTEGER AS is_total
FROM hits GROUP BY ROLLUP (superclass)""")
def q_accuracy_by_superclass(spark, sf):
    d = docs(spark, sf)
    hv = B.encode_batch_hashing(d, "item_id", "tokens", 64, 0)
    t = D.one_shot_tasks_scoped(fx.items_text(spark, sf), 20, 10, SEED)
    vq = hv.select(F.col("item_id").alias("query"), F.col("vector").alias("vq"))
    vs = hv.select(F.col("item_id").alias("support"), F.col("vector").alias("vs"))
    sc = t.join(vq, "query").join(vs, "support").withColumn("p", V.cosine_similarity(F.col("vq"), F.col("vs")))
    h = K.one_shot_hit(sc, ["superclass", "task"])
    out = K.accuracy_by_superclass(h)
    return out.select("superclass", _r(F.col("accuracy")).alias("accuracy"), "tasks", "is_total")
