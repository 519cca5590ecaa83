"""Extra columns that are called as the operators' helpers keep their values; samples of repeated ids stay bounded."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kshot.llm import common as C
from kshot.llm import decontaminate as D
from kshot.llm import langid as L
from kshot.llm import line_rules as R
from kshot.llm import minhash_join as M
from kshot.llm import packing as K
from kshot.llm import pii as P
from kshot.llm import quality_gbt as Q
from kshot.llm import token_counts as T
from kshot.llm import toxicity as X

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
NAMES = ["_rid", "_key", "__key", "_bytes", "_letter", "_th", "_w", "_t", "_l", "_n", "_b", "_p", "_m", "_r", "_j", "_bad", "x", "t", "w", "h",
         "lines", "rid", "kept_", "row", "node", "hash", "pos", "lead", "ctx", "b0", "th", "band", "key", "root", "u", "p", "r", "gone", "_row"]


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(3)
    def text(i):
        w = " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of"]) + str(rng.randint(0, 40)) for _ in range(60))
        return w + (". mail a@b.example 1" if i % 5 == 0 else ".")
    texts = [text(i) for i in range(40)]
    texts[10] = texts[3] + " more"          # near copies
    texts[11] = None
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = plain.select("*", *[F.concat(F.lit(f"{n}="), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    items = spark.createDataFrame([(1, " ".join(texts[7].split()[5:30])), (2, "nothing here")], "item_id int, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    return plain.cache(), extra.cache(), items, labels


OPERATORS = {
    "quality": lambda d, i, l: Q.score(d, Q.train(d, l)),
    "tokens": lambda d, i, l: T.count_tokens(d, BYTE),
    "decontaminate": lambda d, i, l: D.decontaminate(d, i),
    "keep_clean": lambda d, i, l: D.keep_clean(d, i),
    "line_rules": lambda d, i, l: R.clean(d),
    "pii": lambda d, i, l: P.find(d),
    "redact": lambda d, i, l: P.redact(d),
    "langid": lambda d, i, l: L.identify(d, L.train(d, 10)),
    "toxicity": lambda d, i, l: X.score(d, X.train(d, l, {"toxic": F.col("toxic")})),
    "near_duplicates": lambda d, i, l: M.near_duplicates(d),
    "keep_one": lambda d, i, l: M.keep_one(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_keep_their_values(frames, name):
    plain, extra, items, labels = frames
    want, got = OPERATORS[name](plain, items, labels), OPERATORS[name](extra, items, labels)
    own = [c for c in NAMES if c not in want.columns]
    assert set(got.columns) == {*want.columns, *own}
    key = lambda r: repr(r)      # noqa: E731
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    for r in got.select("doc_id", *own).collect():
        assert all(r[c] == f"{c}={r.doc_id}" for c in own)


def test_packing_needs_only_id_and_text(frames):
    plain, extra, _, _ = frames
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got, want = ({tuple(r) for r in K.pack(d, WORD).select("doc_id", "doc_tokens").collect()} for d in (extra, plain))
    assert got == want and set(cols) <= set(K.pack(extra, WORD).columns)


def test_sample_bound_holds_for_repeated_ids(spark):
    many = spark.range(60_000).select((F.col("id") % 600).alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(1).alias("y"))
    assert 200 < C.labelled_rows(many, labels, 400).count() < 600                     # rows repeat: 100 an id
    once = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert 60 < C.labelled_rows(once, labels, 100).count() < 150
    assert C.labelled_rows(once, labels, 1000).count() == 600
    repeated = spark.range(200_000).select((F.col("id") % 2000).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    ids = repeated.groupBy("doc_id").agg(F.max("quality").alias("y"))
    assert 800 < C.labelled_rows(docs, ids, 1000).count() < 1200                      # labels repeat: ids count


def test_sparse_fit_is_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.random((400, 30)) < 0.15
    dense = rng.normal(size=(400, 2))
    y = (x[:, :5].sum(axis=1) + dense[:, 0] + rng.normal(size=400) > 1).astype(float)
    text, feature = np.nonzero(x)
    w = X.fit_logistic(X.Slots(text, feature, 30, dense), y)
    full = np.hstack((x, dense, np.ones((400, 1))))
    p = 1 / (1 + np.exp(-(full @ w)))
    assert np.abs(full.T @ (p - y) + np.r_[np.ones(32), 1e-6] * w).max() < 1e-4


def test_every_slot_over_the_threshold_is_a_feature():
    rng = np.random.default_rng(1)
    y = (np.arange(2000) % 2 == 0).astype(float)[:, None]
    own = np.arange(1000) * 7                           # many terms, each only in texts of the category
    bags = [np.unique(rng.choice(own, 60)) if y[i, 0] else np.array([7001]) for i in range(2000)]
    model = X.fit_chain(bags, y, np.arange(2000) % 4, ["c"])
    assert (model.slot_at >= 0).sum() > 900
