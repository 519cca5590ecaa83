import os

import pytest
from pyspark.sql import functions as F

from kshot.operators import text as B
from kshot.session import shared_dir
from kshot.sources import files as A


def test_tokenize_whitespace_cases(spark):
    df = spark.createDataFrame([("  a  b\n",), ("a\tb",), ("",)], "text string")
    got = [r[0] for r in df.select(B.tokenize(F.col("text"))).collect()]
    assert got == ["  a  b\n".strip().split(" "), "a\tb".strip().split(" "), "".strip().split(" ")]


@pytest.mark.parametrize("n", [0, 3, 4, 5])
def test_padding_lengths(spark, n):
    ids = list(range(1, n + 1))
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    tail = df.select(B.pad_post_trunc_tail(F.col("ids"), 4)).first()[0]
    head = df.select(B.pad_post_trunc_head(F.col("ids"), 4)).first()[0]
    assert tail == (ids[:4] + [0] * 4)[:4]
    assert head == (ids[-4:] if n > 4 else ids) + [0] * (4 - min(n, 4))


def test_vocab_ids_and_encoding(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, ["a", "b", "d"])], "item_id long, tokens array<string>")
    vocab = B.build_vocab_by_freq(B.drop_rare(B.token_count(docs), 1))
    v = {r.token: r.id for r in vocab.collect()}
    assert v == {"<PAD>": 0, "<UNK>": 1, "b": 2, "a": 3}
    enc = {r.item_id: r.ids for r in B.encode_unk(docs, vocab).collect()}
    assert enc == {1: [2, 3, 2, 1], 2: [3, 2, 1]}
    zero = {r.item_id: r.ids for r in B.encode_zero(docs, vocab).collect()}
    assert zero[2] == [3, 2, 0]


def test_encode_strict_fails_on_unseen_token(spark):
    docs = spark.createDataFrame([(1, ["x", "y"])], "item_id long, tokens array<string>")
    vocab = spark.createDataFrame([("x", 2)], "token string, id long")
    with pytest.raises(Exception):
        B.encode_strict(docs, vocab).collect()


def test_pair_lines_reject_bad_rows(spark):
    path = shared_dir(spark, "t_pairs")
    spark.createDataFrame([("x,y,z,1",), ("x,y,1",), ("x,y",), ('"p,q,0"',)], "value string").write.text(path)
    lines = A.read_pair_lines(spark, path)
    assert sorted((r.sent_a, r.sent_b, r.label) for r in lines.where("ok").collect()) == [("p", "q", 0), ("x", "y", 1)]
    assert sorted(r.line for r in lines.where("not ok and label is null").collect()) == ["x,y", "x,y,z,1"]


def test_image_catalog_reads_paths_only(spark):
    root = shared_dir(spark, "t_img")
    for split, sup, cls, f in [("images_background", "alpha", "c1", "a.png"), ("images_evaluation", "beta", "c2", "b.png")]:
        os.makedirs(os.path.join(root, split, sup, cls), exist_ok=True)
        with open(os.path.join(root, split, sup, cls, f), "wb") as fh:
            fh.write(b"\x00\x01")
    cat = A.scan_image_catalog(spark, root)
    assert "content" not in cat.columns
    assert sorted((r.split, r.superclass, r["class"]) for r in cat.collect()) == [
        ("images_background", "alpha", "c1"), ("images_evaluation", "beta", "c2")]


def test_materialize_once_reuses_stage(spark):
    path = shared_dir(spark, "t_stage")
    a = A.materialize_once(spark, path, lambda: spark.range(3))
    assert a.count() == 3
    b = A.materialize_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("recomputed")))
    assert b.count() == 3


def test_pandas_tokenizer_plugin(spark):
    df = spark.createDataFrame([("Hello World",)], "text string")
    tok = B.pandas_tokenizer(lambda t: t.lower().split())
    assert df.select(tok(F.col("text"))).first()[0] == ["hello", "world"]


def test_encode_batch_plugin_sends_each_key_once(spark):
    def factory():
        import numpy as np

        def enc(keys):
            return [np.array([len(k), k.count("a")], dtype=float) for k in keys]
        return enc
    df = spark.createDataFrame([("aa",), ("b",), ("aa",), ("abc",)], "s string")
    out = {r.key: r.vector for r in B.encode_batch(df, "s", factory, 2).collect()}
    assert out == {"aa": [2.0, 2.0], "b": [1.0, 0.0], "abc": [3.0, 1.0]}


def test_vocab_positions_same_for_any_bucket_size(spark):
    toks = spark.range(3000).select(F.array(F.concat(F.lit("w"), (F.col("id") % 997).cast("string")),
                                            F.concat(F.lit("x"), (F.col("id") % 13).cast("string"))).alias("tokens"))
    counts = B.token_count(toks)
    a = sorted(tuple(r) for r in B.build_vocab_by_freq(counts).select("token", "id").collect())
    b = sorted(tuple(r) for r in B.build_vocab_by_freq(counts, rows_per_bucket=5).select("token", "id")
               .collect())
    assert a == b and sorted(i for _, i in a) == list(range(len(a)))
