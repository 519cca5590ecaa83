"""Block kernels equal the column expressions; pivoted and chunked nearest support equal brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kshot.functions import blocks as B
from kshot.functions import vectors as V
from kshot.operators import nearest as N
from kshot.operators.classify import nearest_support

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0], [1.0, None], [None, None], [0.0, 0.0], [1.5, -2.0], [NAN, 1.0], [INF, 0.0], [1e300, -1e300], [1.0, 2.0, 3.0]]


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_pair_kernels_equal_the_columns(spark):
    rows = [(i, j, x, y) for i, x in enumerate(ODD) for j, y in enumerate(ODD)]
    df = spark.createDataFrame(rows, "i int, j int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.manhattan_similarity(a, b), B.manhattan_similarity_blocks(a, b), V.cosine_similarity(a, b),
                    B.cosine_similarity_blocks(a, b), V.l1_distance(a, b), B.l1_distance_blocks(a, b)).collect()
    for r in got:
        assert same(r[0], r[1]) and same(r[2], r[3]) and same(r[4], r[5]), r


@pytest.mark.parametrize("dim", [3, 768, 11_025])
def test_kernels_are_the_same_doubles_at_any_length(spark, dim):
    df = spark.range(40, numPartitions=3).select(
        *[F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k, s=s: ((F.xxhash64("id", k, F.lit(s)) % 1000) / 7.0).cast("float")).alias(c)
          for s, c in enumerate("ab")])
    a, b = F.col("a"), F.col("b")
    got = df.select(V.l1_distance(a, b), B.l1_distance_blocks(a, b), V.cosine_similarity(a, b), B.cosine_similarity_blocks(a, b)).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    x = np.random.default_rng(1).normal(size=(9, dim))
    assert (B.l1_block(x, x[:4]) == np.array([[B.l1_rows(p[None], q)[0] for q in x[:4]] for p in x])).all()


def brute(queries, supports):
    """Nearest by L1, summed left to right; lowest class of equal ones; the lowest class where nothing is defined."""
    out = {}
    for key, q in queries:
        best = None
        for c, s in supports:
            if q is None or s is None or len(q) != len(s) or None in q or None in s:
                continue
            d = 0.0
            for x, y in zip(q, s, strict=True):
                d += abs(x - y)
            best = min(best or (INF, 10**9), (d, c))
        out[key] = (min(c for c, _ in supports), -INF) if best is None else (best[1], math.exp(-best[0]))
    return out


def answers(spark, queries, supports, **how):
    q = spark.createDataFrame(queries, "item_id int, vec array<double>").withColumn("pred_", F.lit(1)).withColumn("_rank", F.lit("x")).repartition(3)
    s = spark.createDataFrame(supports, "class_idx int, vec array<double>").repartition(4)
    got = nearest_support(q, s, **how)
    assert got.columns[:4] == ["item_id", "vec", "pred_", "_rank"]
    return got.collect()


def clustered(rng, n, dim=6, step=0.25):
    centres = [[rng.uniform(-20, 20) for _ in range(dim)] for _ in range(12)]
    return [[round(x + rng.gauss(0, 1) / step) * step for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("max_bytes", [1 << 25, 20_000, 700])
def test_pivots_and_chunks_equal_brute_force(spark, max_bytes):
    rng = random.Random(6)
    vecs = clustered(rng, 900)
    supports = [(i, v) for i, v in enumerate(vecs[:700])] + [(900 + i, vecs[3]) for i in range(60)]    # ties on a grid, copies
    supports += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [1.0, 2.0])]
    rng.shuffle(supports)
    queries = list(enumerate(vecs[680:])) + [(9001, None), (9002, []), (9003, [5.0, 5.0]), (9004, [1.0]), (9005, [1.0, None])]
    got = answers(spark, queries, supports, max_bytes=max_bytes, counted=True)
    want = brute(queries, supports)
    assert {r.item_id: r.pred for r in got} == {k: c for k, (c, _) in want.items()}
    for r in got:
        assert r.score == pytest.approx(want[r.item_id][1], rel=1e-12)
    seen = sum(r.compared for r in got)
    assert 0 < seen < 0.5 * len(queries) * len(supports)


def test_not_finite_vectors_are_compared_with_all(spark):
    rng = random.Random(1)
    supports = [(i, v) for i, v in enumerate(clustered(rng, 400, 2))] + [(500, [INF, 0.0])]
    queries = [(1, [INF, 0.0]), (2, [1.0, 1.0]), (3, [-INF, 2.0])]
    for how in ({}, {"max_bytes": 2_000}):
        got = {r.item_id: r.pred for r in answers(spark, queries, supports, **how)}
        assert got[2] == brute(queries, supports)[2][0]
        assert got[1] == 500      # inf - inf is not a number, which ranks as the greatest, as in Spark


def test_repeated_query_ids_and_empty_sides(spark):
    supports = [(i, [float(i)]) for i in range(5)]
    got = answers(spark, [(1, [0.2]), (1, [3.9]), (1, [3.9])], supports, max_bytes=40)
    assert sorted(r.pred for r in got) == [0, 4, 4]
    assert answers(spark, [], supports) == [] and answers(spark, [], supports, max_bytes=40) == []
    (row,) = answers(spark, [(1, [1.0])], [])
    assert row.pred is None


def test_chunks_stay_under_the_bound(spark):
    rng = random.Random(2)
    rows = [(i, v) for i, v in enumerate(clustered(rng, 600))] + [(1000 + i, [1.0] * 6) for i in range(300)]   # a third equal
    sup = N.write_support(spark.createDataFrame(rows, "class_idx int, vec array<double>"))
    dealt, _, _, spans = N._deal(sup, N.KERNELS[V.manhattan_similarity], 4_000)
    sizes = dealt.groupBy("chunk").agg(F.sum(F.size("vec") * 8 + 24).alias("b")).collect()
    assert sum(r.b for r in sizes) == 900 * 72 and max(r.b for r in sizes) <= 3 * 4_000 and len(spans) == len(sizes)


def test_many_supports_equal_brute_force():
    """100,000 supports: the answer of a full comparison, with a small share of the distances."""
    rng = np.random.default_rng(3)
    centres = rng.uniform(-50, 50, (300, 16))
    vecs = (centres[rng.integers(0, 300, 100_000)] + rng.normal(size=(100_000, 16))).round(1)
    q = (centres[rng.integers(0, 300, 60)] + rng.normal(size=(60, 16))).round(1)
    held = N.Supports(pa.array(list(vecs)), rng.permutation(100_000), N.KERNELS[V.manhattan_similarity])
    rank, classes, compared = held.nearest(pa.array(list(q)))
    cells = held.cells[16]
    d = B.l1_block(q, cells.vectors)
    assert (rank == -d.min(axis=1)).all()
    assert all(classes[i] == cells.classes[d[i] == d[i].min()].min() for i in range(60))
    assert compared.sum() < 0.02 * 60 * 100_000


def test_weak_pivots_compare_in_blocks_with_the_same_answers():
    """Gaussian vectors of 64 dimensions, where pivots leave nearly all: the scan answers as the pruned way, ties too."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(1500, 64)).round(2)
    vecs[700:760] = vecs[3]
    cells = N.Cells(vecs, rng.permutation(1500).astype(np.int32))       # as Spark sends them
    q = np.concatenate([rng.normal(size=(60, 64)).round(2), vecs[:80]])
    for upper in (np.where(np.arange(140) % 2 == 0, 0.0, 40.0), np.full(140, INF)):
        a, b = cells._pruned(q, upper), cells.nearest(q, upper)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert (b[2][N.TRIAL:] == 1500).all()


def test_a_query_travels_once_to_a_shelf(spark):
    """Hundreds of chunks on one shelf: one row a query, and the batch's chunk matrix is cut."""
    rng = random.Random(4)
    sup = N.write_support(spark.createDataFrame(list(enumerate(clustered(rng, 900))), "class_idx int, vec array<double>"))
    _, sample, pivots, spans = N._deal(sup, N.KERNELS[V.manhattan_similarity], 400)
    rings, shelf = N._Rings(pivots, spans, True), np.zeros(len(spans), np.int64)
    to, _ = N._visits(sample, rings, shelf, N.KERNELS[V.manhattan_similarity])(pa.array(clustered(rng, 50)))
    assert len(spans) > 100 and [len(x) for x in to.to_pylist()] == [1] * 50
