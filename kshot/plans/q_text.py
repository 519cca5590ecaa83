"""Queries: tokenise, count, vocabularies, encode, pad, lengths, hashing encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators import sampling as D
from kshot.operators import splits as C
from kshot.operators import text as B
from kshot.operators.positions import global_position
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_sampling import _pairs_sql
from kshot.plans.registry import register
from kshot.session import staged

SEED = 42
TOK = S.tokens()


def docs(spark, sf):
    return fx.items_text(spark, sf).select("item_id", "class", B.tokenize(F.col("text")).alias("tokens"))


def _vocab_freq(spark, sf, low_freq=2, d=None):
    d = d if d is not None else docs(spark, sf)
    return B.build_vocab_by_freq(B.drop_rare(B.token_count(d), low_freq))


def _encoded(spark, sf, encode, low_freq=2, **params):
    """Documents encoded by their own frequency vocabulary; tokens are counted once."""
    d = docs(spark, sf)
    counts = staged(B.token_count(d), "counts")
    return encode(d, B.build_vocab_by_freq(B.drop_rare(counts, low_freq)), counts=counts, **params)


@register("tokenize", f"SELECT doc_id AS item_id, {TOK} AS tokens FROM documents")
def q_tokenize(spark, sf):
    return docs(spark, sf).select("item_id", "tokens")


@register("segment", "SELECT doc_id AS item_id, regexp_split_to_array(text, '[ \n]+') AS tokens FROM documents")
def q_segment(spark, sf):
    d = fx.items_text(spark, sf)
    return B.segment(d, "text", B.regex_tokenizer("[ \n]+")).select("item_id", "tokens")


@register("token_count", f"""WITH {S.DTOK}
SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token""")
def q_token_count(spark, sf):
    return B.token_count(docs(spark, sf))


@register("drop_rare", f"""WITH {S.DTOK}
SELECT token, cnt FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token)
WHERE cnt > 2""")
def q_drop_rare(spark, sf):
    return B.drop_rare(B.token_count(docs(spark, sf)), 2)


@register("drop_stop_words", f"""WITH {S.DTOK},
c AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token),
k AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS place FROM c)
SELECT token, cnt FROM k WHERE place > 20""")
def q_drop_stop_words(spark, sf):
    counts = B.token_count(docs(spark, sf))
    return B.drop_stop_words(counts, B.top_tokens(counts, 20))


@register("build_vocab_by_freq", f"WITH {S.DTOK}, {S.vocab_freq_cte(2)} SELECT token, id FROM vocab")
def q_build_vocab_by_freq(spark, sf):
    return _vocab_freq(spark, sf).select("token", "id")


# three growing stages: the documents of more and more episodes
GROWTH, LOW = (10, 20, 30), 2


@register("append_vocab", f"""WITH {_pairs_sql(E=max(GROWTH)).replace(S.ITEMS_VEC, S.ITEMS_TEXT)}, {S.DTOK},
used AS (SELECT item_id, min(episode) AS first FROM (SELECT episode, a AS item_id FROM pr UNION ALL SELECT episode, b FROM pr) GROUP BY item_id),
st AS (SELECT item_id, {' + '.join(f'(first >= {t})::INTEGER' for t in GROWTH)} AS stage FROM used),
c AS (SELECT token, stage, count(*) AS cnt FROM (SELECT stage, unnest(tokens) AS token FROM dtok JOIN st USING (item_id)) GROUP BY token, stage),
k AS (SELECT token, g.stage, sum(cnt) AS cnt FROM c JOIN (SELECT unnest(range({len(GROWTH)})) AS stage) g ON c.stage <= g.stage GROUP BY token, g.stage),
f AS (SELECT token, min(stage) AS stage, arg_min(cnt, stage) AS cnt FROM k WHERE cnt > {LOW} GROUP BY token)
SELECT token, stage::INTEGER AS stage, (row_number() OVER (ORDER BY stage, cnt DESC, token) + 1)::BIGINT AS id FROM f""")
def q_append_vocab(spark, sf):
    """Growing vocabulary: ids of earlier stages stay, new tokens follow them."""
    ep = D.sample_episodes(fx.items_text(spark, sf), max(GROWTH), 5, 5, SEED)
    pr = D.episode_pairs(ep, 300, SEED, 25)
    used = pr.select("episode", F.explode(F.array("a", "b")).alias("item_id")).groupBy("item_id").agg(F.min("episode").alias("first"))
    stage = sum(((F.col("first") >= t).cast("int") for t in GROWTH), F.lit(0))
    texts = staged(docs(spark, sf).join(used.withColumn("stage", stage), "item_id").select("stage", "tokens"), "growth")
    vocab, counts, out = None, None, None
    for s in range(len(GROWTH)):
        delta = B.token_count(texts.where(F.col("stage") == s))
        counts = staged(delta if counts is None else B.merge_counts(counts, delta), "counts")
        grown = B.append_vocab(vocab, counts, LOW)
        new = (grown.where("id > 1") if vocab is None else grown.join(vocab.select("id"), "id", "left_anti")).withColumn("stage", F.lit(s))
        vocab, out = grown, new if out is None else out.unionByName(new)
    return out.select("token", "stage", "id")


def _pair_sides(spark, sf, E=20):
    items = fx.items_text(spark, sf)
    ep = D.sample_episodes(items, E, 5, 5, SEED)
    pr = D.episode_pairs(ep, 300, SEED, 25)
    pr = global_position(pr, [F.col("episode"), F.col("pair_no")], [F.col("episode")], "pair_pos")
    return pr.select("pair_pos", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("item_id")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("item_id")))).alias("s")).select("pair_pos", "s.*")



_PT_SQL = f"""{_pairs_sql(E=20).replace(S.ITEMS_VEC, S.ITEMS_TEXT)}, {S.DTOK},
pp AS (SELECT a, b, row_number() OVER (ORDER BY episode, pair_no) AS pair_pos FROM pr),
sides AS (SELECT pair_pos, 0 AS side, a AS item_id FROM pp UNION ALL SELECT pair_pos, 1 AS side, b FROM pp),
st AS (SELECT s.pair_pos, s.side, s.item_id, d.tokens FROM sides s JOIN dtok d USING (item_id))"""


@register("build_vocab_by_first_seen", f"""WITH {_PT_SQL},
ex AS (SELECT pair_pos, side, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS tpos FROM st),
f AS (SELECT token, pair_pos, side, tpos,
      row_number() OVER (PARTITION BY token ORDER BY pair_pos, side, tpos) AS k FROM ex)
SELECT token, row_number() OVER (ORDER BY pair_pos, side, tpos)::BIGINT AS id FROM f WHERE k = 1""")
def q_build_vocab_by_first_seen(spark, sf):
    return B.build_vocab_by_first_seen(_pair_sides(spark, sf), docs(spark, sf))


@register("encode_unk", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {S.encode_cte('dtok', 'vocab', 1)}
SELECT item_id, ids FROM enc""")
def q_encode_unk(spark, sf):
    return _encoded(spark, sf, B.encode_unk)


_HALF = f"""items AS (SELECT doc_id AS item_id, concat_ws('/', lang, source) AS class, text FROM documents),
cl AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(11, '@class')}, class) AS rk, count(*) OVER () AS cc
       FROM (SELECT DISTINCT class FROM items)),
half AS (SELECT i.item_id, {S.tokens('i.text')} AS tokens,
         CASE WHEN rk <= floor(cc * 0.5) THEN 'background' ELSE 'evaluation' END AS split
         FROM items i JOIN cl USING (class)),
bg AS (SELECT * FROM half WHERE split = 'background'),
ev AS (SELECT * FROM half WHERE split = 'evaluation')"""


@register("encode_zero", f"""WITH {_HALF}, {S.vocab_freq_cte(0, 'bg')}, {S.encode_cte('ev', 'vocab', 0)}
SELECT item_id, ids FROM enc""")
def q_encode_zero(spark, sf):
    d = C.background_evaluation(docs(spark, sf), 0.5, 11)
    bg = d.where(F.col("split") == "background")
    ev = d.where(F.col("split") == "evaluation")
    vocab = B.build_vocab_by_freq(B.drop_rare(B.token_count(bg), 0))
    return B.encode_zero(ev, vocab)


@register("encode_strict", f"""WITH {S.DTOK}, {S.vocab_freq_cte(0)}, {S.encode_cte('dtok', 'vocab', 1)}
SELECT item_id, ids FROM enc""")
def q_encode_strict(spark, sf):
    return _encoded(spark, sf, B.encode_strict, 0)


@register("pad_post_trunc_tail", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {S.encode_cte('dtok', 'vocab', 1)}
SELECT item_id, list_concat(ids, {S.zeros(100)})[1:100] AS ids FROM enc""")
def q_pad_post_trunc_tail(spark, sf):
    enc = _encoded(spark, sf, B.encode_unk, max_len=100, keep="head")
    return enc.select("item_id", B.pad_post_trunc_tail(F.col("ids"), 100).alias("ids"))


@register("pad_post_trunc_head", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {S.encode_cte('dtok', 'vocab', 1)}
SELECT item_id, list_concat(ids[greatest(len(ids) - 100, 0) + 1 : greatest(len(ids) - 100, 0) + 100],
  {S.zeros(100)})[1:100] AS ids FROM enc""")
def q_pad_post_trunc_head(spark, sf):
    enc = _encoded(spark, sf, B.encode_unk, max_len=100, keep="tail")
    return enc.select("item_id", B.pad_post_trunc_head(F.col("ids"), 100).alias("ids"))


@register("length_stats", f"""WITH {_PT_SQL}
SELECT max(len(tokens))::INTEGER AS max_len, {S.r('avg(len(tokens))')} AS mean_len FROM st""")
def q_length_stats(spark, sf):
    lens = docs(spark, sf).select("item_id", F.size("tokens").alias("len"))
    st = _pair_sides(spark, sf).join(lens, "item_id")
    return B.length_stats(st).select("max_len", (F.round("mean_len", 6) + F.lit(0.0)).alias("mean_len"))


@register("vocab_size", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {_PT_SQL.replace(S.DTOK, 'dt2 AS (SELECT 1)')}
SELECT (SELECT count(*) FROM vocab) AS by_freq,
       (SELECT count(DISTINCT token) FROM (SELECT unnest(tokens) AS token FROM st)) AS by_first_seen""")
def q_vocab_size(spark, sf):
    a = B.vocab_size(_vocab_freq(spark, sf)).withColumnRenamed("vocab_size", "by_freq")
    b = B.vocab_size(B.build_vocab_by_first_seen(_pair_sides(spark, sf), docs(spark, sf))).withColumnRenamed(
        "vocab_size", "by_first_seen")
    return a.crossJoin(b)


def token_vectors(spark, sf, vocab):
    """Fixture: vocabulary id -> embeddings.vec_id = id % count(embeddings); ids with id % 10 = 3 missing."""
    emb = fx.table(spark, sf, "embeddings")
    n = emb.agg(F.count(F.lit(1)).alias("_n"))
    v = vocab.where(F.col("id") % 10 != 3).crossJoin(n).withColumn("vec_id", F.col("id") % F.col("_n"))
    return v.join(emb.select("vec_id", "embedding"), "vec_id").select(
        "token", F.col("id").cast("int").alias("id"), F.col("embedding").alias("vector"))


TVEC_SQL = """tvec AS (SELECT v.token, v.id::INTEGER AS id, e.embedding AS vector FROM vocab v
  JOIN embeddings e ON e.vec_id = v.id % (SELECT count(*) FROM embeddings) WHERE v.id % 10 <> 3)"""


@register("missing_vectors", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {TVEC_SQL}
SELECT token, id FROM vocab WHERE token NOT IN (SELECT token FROM tvec)""")
def q_missing_vectors(spark, sf):
    vocab = _vocab_freq(spark, sf).select("token", "id")
    return B.missing_vectors(vocab, token_vectors(spark, sf, vocab))


@register("encode_batch", f"""WITH {S.DTOK},
ex AS (SELECT item_id, ('0x' || substr(md5(concat_ws('|', '0', token)), 1, 8))::BIGINT % 64 AS b,
       CASE WHEN ('0x' || substr(md5(concat_ws('|', '0', token)), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END AS s
       FROM (SELECT item_id, unnest(tokens) AS token FROM dtok)),
g AS (SELECT item_id, b, sum(s) AS v FROM ex GROUP BY item_id, b),
fl AS (SELECT d.item_id, j.j AS b, coalesce(g.v, 0.0) AS v FROM (SELECT DISTINCT item_id FROM ex) d
       CROSS JOIN range(64) j(j) LEFT JOIN g ON g.item_id = d.item_id AND g.b = j.j)
SELECT item_id, list(v::DOUBLE ORDER BY b) AS vector FROM fl GROUP BY item_id""")
def q_encode_batch(spark, sf):
    return B.encode_batch_hashing(docs(spark, sf), "item_id", "tokens", 64, 0)
