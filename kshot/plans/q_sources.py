"""Queries for sources and sinks (A1-A11): data derived from the tables is written to the shared folder
in the layout the reader expects, read back, and compared with the same rows computed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators import classify as K
from kshot.operators import splits as C
from kshot.operators import text as B
from kshot.sources import files as A
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_sampling import _pairs, _pairs_sql
from kshot.plans.q_text import TVEC_SQL, _vocab_freq, docs, token_vectors
from kshot.plans.q_vectors import VP, _WSQL, vec_pairs, W, B0, KEYS, KS
from kshot.plans.registry import register
from kshot.functions import vectors as V
from kshot.session import shared_dir


def _doc_tree(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select(F.concat_ws("_", "lang", "source").alias("class"), "doc_id",
                    F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")


@register("scan_class_tree", "SELECT lang || '_' || source AS class, doc_id AS item_id, text FROM documents")
def q_scan_class_tree(spark, sf):
    root = shared_dir(spark, "class_tree")
    A.write_class_tree(_doc_tree(spark, sf), root, "class", "name", "text")
    t = A.scan_class_tree(spark, root)
    return t.select("class", F.regexp_extract("name", r"^(\d+)\.txt$", 1).cast("bigint").alias("item_id"), "text")


@register("scan_class_csv", "SELECT lang || '_' || source || '.csv' AS class, text AS sentence FROM documents")
def q_scan_class_csv(spark, sf):
    root = shared_dir(spark, "class_csv")
    d = _doc_tree(spark, sf).withColumn("file", F.concat(F.col("class"), F.lit(".csv")))
    A.write_class_csv(d, root, "file", "text")
    return A.scan_class_csv(spark, root)


@register("scan_image_catalog", f"""WITH c AS (SELECT DISTINCT 'c' || label AS class FROM embeddings),
r AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(11, '@class')}, class) AS rk, count(*) OVER () AS cc FROM c)
SELECT CASE WHEN rk <= floor(cc * 0.6) THEN 'background' ELSE 'evaluation' END AS split,
  'g' || (e.label % 2) AS superclass, 'c' || e.label AS class, e.vec_id AS item_id
FROM embeddings e JOIN r ON r.class = 'c' || e.label""")
def q_scan_image_catalog(spark, sf):
    im = fx.images(spark, sf).select("item_id", F.concat(F.lit("c"), F.col("class")).alias("class"),
                                     F.concat(F.lit("g"), (F.col("class") % 2).cast("string")).alias("superclass"),
                                     "pixels")
    im = C.background_evaluation(im, 0.6, 11)
    files = im.select(F.concat_ws("/", "split", "superclass", "class").alias("dir"),
                      F.concat(F.col("item_id").cast("string"), F.lit(".img")).alias("name"),
                      F.array_join(F.transform("pixels", lambda x: x.cast("string")), " ").alias("body"))
    root = shared_dir(spark, "images")
    A.write_class_tree(files, root, "dir", "name", "body")
    cat = A.scan_image_catalog(spark, root)
    return cat.select("split", "superclass", "class",
                      F.regexp_extract("path", r"/(\d+)\.img$", 1).cast("bigint").alias("item_id"))


_CONV_PAIRS = """cp AS (SELECT x.text AS a, y.text AS b, CASE WHEN x.role = y.role THEN 1 ELSE 0 END AS label
  FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)"""


@register("read_pair_lines", f"""WITH {_CONV_PAIRS},
ln AS (SELECT unnest(string_split(a || ',' || b || ',' || label, chr(10))) AS line FROM cp),
uq AS (SELECT CASE WHEN line LIKE '"%"' AND length(line) >= 2 THEN replace(line[2:length(line) - 1], '""', '"')
       ELSE line END AS v, line FROM ln),
pt AS (SELECT line, string_split(v, ',') AS p FROM uq)
SELECT line, CASE WHEN ok THEN p[1] END AS sent_a, CASE WHEN ok THEN p[2] END AS sent_b,
  CASE WHEN ok THEN p[3]::INTEGER END AS label, ok
FROM (SELECT line, p, coalesce(len(p) = 3 AND p[3] IN ('0', '1'), false) AS ok FROM pt)""")
def q_read_pair_lines(spark, sf):
    c = fx.table(spark, sf, "conversations")
    x = c.select("conv_id", "turn", F.col("text").alias("a"), F.col("role").alias("ra"))
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"), F.col("role").alias("rb"))
    pairs = x.join(y, ["conv_id", "turn"]).withColumn("label", (F.col("ra") == F.col("rb")).cast("int"))
    path = shared_dir(spark, "pair_lines")
    A.pair_lines(pairs, "a", "b", "label").write.text(path)
    return A.read_pair_lines(spark, path)


@register("write_pairs", f"""WITH {_pairs_sql()}
SELECT episode::BIGINT AS episode, pair_no::INTEGER AS pair_no, a, b, label FROM pr""")
def q_write_pairs(spark, sf):
    _, pr = _pairs(spark, sf)
    path = shared_dir(spark, "pairs")
    A.write_pairs(pr, path)
    return spark.read.parquet(path)


@register("save_load_vocab", f"WITH {S.DTOK}, {S.vocab_freq_cte(2)} SELECT token, id FROM vocab")
def q_save_load_vocab(spark, sf):
    path = shared_dir(spark, "vocab")
    A.save_vocab(_vocab_freq(spark, sf), path)
    return A.load_vocab(spark, path)


@register("load_word_vectors", f"""WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {TVEC_SQL}
SELECT token, vector FROM tvec""")
def q_load_word_vectors(spark, sf):
    vocab = _vocab_freq(spark, sf).select("token", "id")
    tv = token_vectors(spark, sf, vocab)
    path = shared_dir(spark, "word_vectors")
    A.write_word_vectors(tv, path, 64)
    return A.load_word_vectors(spark, path, 64)


@register("load_id_vectors", f"WITH {S.DTOK}, {S.vocab_freq_cte(2)}, {TVEC_SQL} SELECT id, vector FROM tvec")
def q_load_id_vectors(spark, sf):
    vocab = _vocab_freq(spark, sf).select("token", "id")
    tv = token_vectors(spark, sf, vocab)
    path = shared_dir(spark, "id_vectors")
    A.write_id_vectors(tv, path)
    return A.load_id_vectors(spark, path)


@register("load_stop_words", f"""WITH {S.DTOK},
c AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token)
SELECT token FROM c ORDER BY cnt DESC, token LIMIT 20""")
def q_load_stop_words(spark, sf):
    top = B.top_tokens(B.token_count(docs(spark, sf)), 20)
    path = shared_dir(spark, "stop_words")
    top.select(F.concat(F.lit("  "), F.col("token"), F.lit(" ")).alias("value")).write.text(path)
    return A.load_stop_words(spark, path)


@register("write_predictions", f"WITH {VP} SELECT {KS}, CASE WHEN {_WSQL} > 0.5 THEN 1 ELSE 0 END AS pred FROM vp")
def q_write_predictions(spark, sf):
    p = vec_pairs(spark, sf)
    pred = p.select(*KEYS, K.predict_pairs(V.weighted_l1_probability(F.col("va"), F.col("vb"), W, B0)).alias("pred"))
    path = shared_dir(spark, "predictions")
    A.write_predictions(pred, path)
    return A.read_predictions(spark, path, "class int, round int, pair_no int, label int, pred int")


@register("materialize_once", f"""WITH {S.DTOK}
SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token""")
def q_materialize_once(spark, sf):
    path = shared_dir(spark, "stage_counts")
    first = A.materialize_once(spark, path, lambda: B.token_count(docs(spark, sf)))
    first.count()
    # second call finds _SUCCESS and reads the stored stage without recomputing
    return A.materialize_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("recomputed")))


@register("reuse_stage", f"""WITH {S.DTOK}
SELECT token, count(*) AS cnt, true AS reused FROM (SELECT unnest(tokens) AS token FROM dtok) GROUP BY token""")
def q_reuse_stage(spark, sf):
    """A stage found again by its plan and input files: the second, newly built plan reads the files of the first."""
    root = shared_dir(spark, "stages")
    first = A.reuse_stage(B.token_count(docs(spark, sf)), root, "token_counts")
    again = A.reuse_stage(B.token_count(docs(spark, sf)), root, "token_counts")
    return again.withColumn("reused", F.lit(sorted(first.inputFiles()) == sorted(again.inputFiles())))
