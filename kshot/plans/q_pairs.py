"""Query: text pairs of unseen classes scored with the vocabulary of the training classes, in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators import embedding as EM
from kshot.operators import sampling as D
from kshot.operators import splits as C
from kshot.operators import text as B
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.evaluate import score_pairs
from kshot.plans.q_sampling import SEED, d1_ctes
from kshot.plans.q_text import TVEC_SQL, docs, token_vectors
from kshot.plans.q_vectors import DIM
from kshot.plans.registry import register
from kshot.session import staged

_VALIDATION = f"""allitems AS (SELECT doc_id AS item_id, concat_ws('/', lang, source) AS class, text FROM documents),
spl AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(7, '@class')}, class) <= floor(count(*) OVER () * 0.8) AS train
        FROM (SELECT DISTINCT class FROM allitems)),
items AS (SELECT item_id, class FROM allitems JOIN spl USING (class) WHERE NOT train)"""


@register("score_text_pairs", f"""WITH {d1_ctes(_VALIDATION, 20)},
ttok AS (SELECT item_id, {S.tokens()} AS tokens FROM allitems JOIN spl USING (class) WHERE train),
{S.vocab_freq_cte(2, 'ttok')}, {TVEC_SQL},
zm AS (SELECT v.id::INTEGER AS id, CASE WHEN v.id <> 0 AND t.vector IS NOT NULL THEN list_transform(t.vector, lambda x: x::DOUBLE)
       ELSE {S.zeros(DIM).replace('lambda x: 0', 'lambda x: 0.0')} END AS vector FROM vocab v LEFT JOIN tvec t USING (token)),
vtok AS (SELECT item_id, {S.tokens()} AS tokens FROM allitems WHERE item_id IN (SELECT a FROM d1 UNION SELECT b FROM d1)),
{S.encode_cte('vtok', 'vocab', 1)},
ex AS (SELECT DISTINCT item_id, unnest(list_concat(ids, {S.zeros(100)})[1:100]) AS id FROM enc),
el AS (SELECT ex.item_id, unnest(zm.vector) AS x, generate_subscripts(zm.vector, 1) AS d FROM ex JOIN zm USING (id)),
mx AS (SELECT item_id, d, max(x) AS x FROM el GROUP BY item_id, d),
pv AS (SELECT item_id, list(x ORDER BY d) AS v FROM mx GROUP BY item_id),
sc AS (SELECT d1.*, coalesce({S.cosine('pa.v', 'pb.v')}, 0.0) AS p FROM d1 JOIN pv pa ON pa.item_id = d1.a
       JOIN pv pb ON pb.item_id = d1.b)
SELECT class, round, pair_no, a, b, label, {S.r('p')} AS p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM sc""")
def q_score_text_pairs(spark, sf):
    items = fx.items_text(spark, sf).select("item_id", "class")
    split = staged(C.split_classes(items, 0.8, 7), "class_split")
    pairs = staged(D.sample_balanced_pairs(C.restrict(items, split, "validation"), 20, SEED), "pairs")
    d = docs(spark, sf)
    counts = B.token_count(C.restrict(d, split, "train"))
    vocab = B.build_vocab_by_freq(B.drop_rare(counts, 2)).select("token", "id")
    matrix = EM.embedding_matrix_zero(vocab, token_vectors(spark, sf, vocab), DIM)
    out = score_pairs(pairs, d, vocab, matrix, DIM)
    return out.withColumn("p", F.round("p", 6) + F.lit(0.0))
