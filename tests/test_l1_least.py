"""Least distances by rounded numbers: the doubles and classes of all distances, and chunks that all must visit in one."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kshot.functions import blocks as BK
from kshot.operators import nearest as N
from kshot.operators.classify import nearest_support


def _want(q, s, classes):
    d = BK.l1_block(q, s)
    return d.min(axis=1), np.where(d == d.min(axis=1)[:, None], classes, classes.max() + 1).min(axis=1)


@pytest.mark.parametrize("dims", [1, 3, 64, 65, 200])
@pytest.mark.parametrize("kind", ["normal", "few values", "far query", "offset", "huge", "tiny", "same"])
def test_least_is_that_of_all_distances(dims, kind):
    rng = np.random.default_rng(dims)
    q, s = rng.normal(size=(70, dims)), rng.normal(size=(900, dims))
    if kind == "few values":
        q, s = np.rint(q), np.rint(s)
    elif kind == "far query":
        q[5] += 1e6
    elif kind == "offset":
        q, s = q + 1e9, s + 1e9
    elif kind in ("huge", "tiny"):
        q, s = q * (1e99 if kind == "huge" else 1e-300), s * (1e99 if kind == "huge" else 1e-300)
    elif kind == "same":
        q, s = np.ones_like(q), np.ones_like(s)
    s[100:200] = s[300:400]                                                              # ties
    classes = rng.permutation(900).astype(np.int32)
    for got, want in zip(BK.l1_least(q, s, classes), _want(q, s, classes), strict=True):
        assert np.array_equal(got, want)


def test_rounded_search_takes_a_fraction_of_the_time():
    rng = np.random.default_rng(3)
    q, s = rng.normal(size=(128, 64)), rng.normal(size=(20_000, 64))
    cells = N.Cells(s, np.arange(len(s), dtype=np.int32))
    def took(f, *a):
        best = []
        for _ in range(3):
            t = time.time()
            f(*a)
            best.append(time.time() - t)
        return min(best)
    assert took(cells._scanned, q, np.full(len(q), np.inf)) < 0.6 * took(BK.l1_block, q, s)


def test_chunks_that_all_queries_visit_are_met_as_one(spark):
    """Random directions: no pivot helps, every query meets every chunk, answers are those of all distances."""
    rng = np.random.default_rng(4)
    s, q = rng.normal(size=(1500, 16)), rng.normal(size=(80, 16))
    sup = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(s)], "class_idx int, vec array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "item_id long, vec array<double>")
    least, near = _want(q, s, np.arange(1500))
    for bound in (4096, 1 << 20):
        got = nearest_support(qs, sup, counted=True, max_bytes=bound).orderBy("item_id").collect()
        assert [r.pred for r in got] == near.tolist() and all(0 < r.compared <= 1500 for r in got)
        assert [r.score for r in got] == [r.e for r in spark.createDataFrame([(float(-x),) for x in least], "x double").coalesce(1).select(F.exp("x").alias("e")).collect()]
