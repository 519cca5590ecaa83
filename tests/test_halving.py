"""Gradients of many heads in one scan against numpy, the update rule, rungs and their rankings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kshot.operators import halving as M
from kshot.operators import learn as H


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(300, 6)), rng.normal(size=(300, 6))
    label = (np.abs(a - b)[:, :3].sum(axis=1) < np.abs(a - b)[:, 3:].sum(axis=1)).astype(int)
    rows = [(x.tolist(), y.tolist(), int(z)) for x, y, z in zip(a, b, label, strict=True)]
    odd = [(None, [1.0] * 6, 1), ([1.0] * 5, [1.0] * 5, 1), ([1.0] * 6, [1.0] * 5 + [None], 0), ([1.0] * 6, [0.0] * 6, None)]
    df = spark.createDataFrame(rows + odd, "va array<double>, vb array<double>, label int").repartition(5)
    return df, a, b, label


@pytest.mark.parametrize("kind", ["absdiff", "concat"])
def test_gradients_of_all_heads_equal_numpy(data, kind):
    df, a, b, y = data
    x = np.hstack((np.ones((300, 1)), np.abs(a - b) if kind == "absdiff" else np.hstack((a, b))))
    w = np.random.default_rng(1).normal(size=(7, x.shape[1]))
    got, loss, n = M.gradients(df, w, kind)
    p = 1 / (1 + np.exp(-(x @ w.T)))
    assert n == 300
    np.testing.assert_allclose(got, (p - y[:, None]).T @ x / 300, atol=1e-12)
    np.testing.assert_allclose(loss, -(y[:, None] * np.log(p) + (1 - y[:, None]) * np.log(1 - p)).mean(axis=0), atol=1e-12)


def test_step_follows_the_schedule():
    s = {"learning_rate": 0.1, "Dense1_multiplier": 2.0, "momentum": 0.6, "momentum_slope": 0.04, "l2_penalization_Dense1": 0.5}
    heads = M.Heads.start([s], 1)
    g = np.array([[1.0, 2.0]])
    w, v = np.zeros(2), np.zeros(2)
    for t in range(4):
        v = min(0.5 + 0.04 * t, 0.62) * v - 0.2 * 0.99 ** (t // 500) * (g[0] + np.array([0.0, w[1]]))     # 2 * 0.5 * w
        w = w + v
        heads.step(g, 1)
    np.testing.assert_allclose(heads.weights[0], w)
    low = M.Heads.start([{**s, "momentum": 0.1}], 1)         # a final momentum under 0.5 never shrinks it
    low.step(g, 1)
    low.step(g, 1)
    np.testing.assert_allclose(low.velocity[0, 0], 0.5 * -0.2 - 0.2)


def test_rungs_drop_the_worse_half_and_the_best_head_separates(spark, data):
    df, a, b, y = data
    cands = H.sample_search_space(spark, 8, 3).withColumn("learning_rate", F.col("candidate") * 1e-3) \
        .withColumn("Dense1_multiplier", F.lit(1.0)).withColumn("l2_penalization_Dense1", F.lit(0.0))
    # a task: pair 0 is a positive, pair 1 a negative
    pos, neg = np.flatnonzero(y == 1)[:100], np.flatnonzero(y == 0)[:100]
    rows = [(t, k, a[i].tolist(), b[i].tolist()) for t, pair in enumerate(zip(pos, neg, strict=True)) for k, i in enumerate(pair)]
    tasks = spark.createDataFrame(rows, "task int, pair_no int, va array<double>, vb array<double>")
    out, best = M.successive_halving(cands, df, tasks, [3, 3, 20], steps=500)
    rows = out.collect()
    assert [sum(r.rung == k for r in rows) for k in range(3)] == [8, 4, 2]
    assert [sum(r.kept for r in rows if r.rung == k) for k in range(3)] == [4, 2, 1]
    for rung in range(2):
        kept = {r.candidate for r in rows if r.rung == rung and r.kept}
        assert kept == {r.candidate for r in rows if r.rung == rung + 1}
        key = {r.candidate: (r.objective, round(r.loss, 9), r.candidate) for r in rows if r.rung == rung}
        assert max(key[c] for c in kept) < min([v for c, v in key.items() if c not in kept])
    (won,) = [r for r in rows if r.is_best]
    assert won.rung == 2 and won.iterations == 26 * 500 and won.objective < 0.15
    assert len(best.settings) == 1 and best.settings[0]["candidate"] == won.candidate
    assert len({r.momentum for r in rows}) > 3 and len({r.momentum_slope for r in rows}) > 3


def test_empty_pairs_and_tasks(spark):
    none = spark.createDataFrame([], "va array<double>, vb array<double>, label int")
    tasks = spark.createDataFrame([], "task int, pair_no int, va array<double>, vb array<double>")
    out, _ = M.successive_halving(H.sample_search_space(spark, 4, 1), none, tasks, [1, 1])
    assert [(r.rung, r.objective, r.loss) for r in out.collect()] == [(0, 1.0, 0.0)] * 4 + [(1, 1.0, 0.0)] * 2
