import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kshot.operators import learn as H
from kshot.operators import sampling as D
from kshot.plans import fixtures as fx
from tests.conftest import SF001


def test_logistic_head_beats_constant_predictor(spark):
    it = fx.items_vec(spark, SF001)
    pr = D.sample_balanced_pairs(it, 20, 3)
    vec = it.select("item_id", "vec")
    pr = (pr.join(vec.select(F.col("item_id").alias("a"), F.col("vec").alias("va")), "a")
          .join(vec.select(F.col("item_id").alias("b"), F.col("vec").alias("vb")), "b"))
    model = H.fit_logistic_absdiff(pr, 0.0, 100)
    row = H.evaluate_model(model, pr, "absdiff").first()
    assert row.loss < math.log(2) and 0.0 <= row.accuracy <= 1.0


def _pairs(spark, m=20):
    it = fx.items_vec(spark, SF001)
    vec = it.select("item_id", "vec")
    return (D.sample_balanced_pairs(it, m, 3)
            .join(vec.select(F.col("item_id").alias("a"), F.col("vec").alias("va")), "a")
            .join(vec.select(F.col("item_id").alias("b"), F.col("vec").alias("vb")), "b"))


def _newton(x, y, reg):
    """Minimum of mean log loss + reg / 2 * |w|^2 over standardised features, intercept free."""
    sd = x.std(axis=0, ddof=1)
    z = np.hstack([x / np.where(sd > 0, sd, 1), np.ones((len(x), 1))])
    w, pen = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], reg), 0.0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (p - y) / len(y) + pen * w
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(pen), grad)
    return 1 / (1 + np.exp(-z @ w))


@pytest.mark.parametrize("kind", ["absdiff", "concat"])
def test_logistic_heads_reach_the_optimum(spark, kind):
    pr = _pairs(spark).cache()
    rows = pr.collect()
    a, b = (np.array([r[c] for r in rows], float) for c in ("va", "vb"))
    x = np.abs(a - b) if kind == "absdiff" else np.hstack([a, b])
    y = np.array([r.label for r in rows], float)
    best = _newton(x, y, 0.05)
    fit = H.fit_logistic_absdiff if kind == "absdiff" else H.fit_logistic_concat
    row = H.evaluate_model(fit(pr, 0.05, 300), pr, kind).first()
    loss = -np.mean(y * np.log(best) + (1 - y) * np.log(1 - best))
    assert abs(row.loss - loss) < 2e-3
    assert abs(row.accuracy - np.mean((best > 0.5) == (y > 0.5))) < 0.02
    pr.unpersist()


def test_evaluate_model_equals_a_forward_pass_in_numpy(spark):
    pr = _pairs(spark, 5)
    model = H.fit_mlp(pr, "absdiff", (8,), 20)
    rows = pr.collect()
    a, b = (np.array([r[c] for r in rows], float) for c in ("va", "vb"))
    y = np.array([r.label for r in rows], float)
    w, dim = np.array(model.weights), a.shape[1]
    n1 = dim * 8
    w1, b1 = w[:n1].reshape(8, dim, order="F"), w[n1:n1 + 8]
    w2, b2 = w[n1 + 8:n1 + 24].reshape(2, 8, order="F"), w[n1 + 24:]
    hidden = 1 / (1 + np.exp(-(np.abs(a - b) @ w1.T + b1)))
    out = hidden @ w2.T + b2
    p = 1 / (1 + np.exp(out[:, 0] - out[:, 1]))
    row = H.evaluate_model(model, pr, "absdiff").first()
    assert abs(row.loss + np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) < 1e-4
    assert row.accuracy == np.mean((p > 0.5) == (y > 0.5))


def test_search_scores_every_candidate():
    cands = [{"candidate": i, "reg": r} for i, r in enumerate((0.5, 0.1, 0.3))]
    res = H.search(cands, fit=lambda c: c["reg"], objective=lambda reg: abs(reg - 0.1))
    assert [r["candidate"] for r in res] == [0, 1, 2]
    assert min(res, key=lambda r: r["objective"])["candidate"] == 1
