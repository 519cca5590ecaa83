import pytest
from pyspark.sql import functions as F

from kshot.operators import classify as K
from kshot.operators import metrics as M


def ref_binary(pred, true, beta=1.0, positive=1):
    n = len(pred)
    acc = sum(p == t for p, t in zip(pred, true)) / n if n else 0
    pp = sum(p == positive for p in pred)
    tp = sum(p == positive and t == positive for p, t in zip(pred, true))
    ap = sum(t == positive for t in true)
    prec = tp / pp if pp else 0
    rec = tp / ap if ap else 0
    den = beta * beta * prec + rec
    f = (1 + beta * beta) * prec * rec / den if den else 0
    return acc, rec, prec, f


def frame(spark, pred, true):
    return spark.createDataFrame(list(zip(pred, true)), "pred int, actual int")


@pytest.mark.parametrize("pred,true", [
    ([], []),
    ([0, 0, 0, 0], [1, 0, 1, 0]),
    ([1, 0, 1, 1, 0], [1, 1, 0, 1, 0]),
])
def test_binary_metrics_match_reference_definitions(spark, pred, true):
    df = frame(spark, pred, true) if pred else spark.createDataFrame([], "pred int, actual int")
    got = M.binary_metrics(df, beta=2.0).first()
    exp = ref_binary(pred, true, 2.0)
    assert [round(x, 12) for x in got] == [round(x, 12) for x in exp]


def test_macro_metrics_count_unpredicted_labels_as_zero(spark):
    df = frame(spark, [0, 0, 1, 1], [0, 1, 1, 2])
    labels = spark.createDataFrame([(0,), (1,), (2,)], "label int")
    got = M.multi_metrics(df, labels).first()
    pr = [ref_binary([0, 0, 1, 1], [0, 1, 1, 2], 1.0, k) for k in (0, 1, 2)]
    assert abs(got.precision - sum(p[2] for p in pr) / 3) < 1e-12
    assert abs(got.recall - sum(p[1] for p in pr) / 3) < 1e-12
    assert abs(got.f_beta - sum(p[3] for p in pr) / 3) < 1e-12
    assert got.accuracy == 0.5


def test_nearest_support_tie_goes_to_lowest_class(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "item_id long, vec array<float>")
    s = spark.createDataFrame([(2, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 3.0])], "class_idx int, vec array<float>")
    assert K.nearest_support(q, s).first().pred == 0


def test_chunked_path_equals_broadcast_path(spark):
    q = spark.range(50).select(F.col("id").alias("item_id"),
                               F.array((F.col("id") % 7).cast("float"), (F.col("id") % 5).cast("float")).alias("vec"))
    s = spark.range(12).select(F.col("id").cast("int").alias("class_idx"),
                               F.array((F.col("id") % 4).cast("float"), (F.col("id") % 3).cast("float")).alias("vec"))
    a = sorted(tuple(r) for r in K.nearest_support(q, s).select("item_id", "pred").collect())
    b = sorted(tuple(r) for r in K.nearest_support(q, s, max_broadcast_rows=5, queries_per_task=7)
               .select("item_id", "pred").collect())
    assert a == b


def test_flat_scores_are_a_miss_and_pair0_max_is_a_hit(spark):
    rows = [(0, 0, 0.5), (0, 1, 0.5), (0, 2, 0.5), (1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.2), (2, 0, 0.1), (2, 1, 0.9),
            (2, 2, 0.3)]
    df = spark.createDataFrame(rows, "task int, pair_no int, p double")
    hits = {r.task: r.hit for r in K.one_shot_hit(df, ["task"]).collect()}
    assert hits == {0: 0, 1: 1, 2: 0}


def test_rollup_adds_total_row(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "superclass string, hit int")
    rows = {(r.superclass, r.is_total): r.accuracy for r in K.accuracy_by_superclass(df).collect()}
    assert rows[("a", 0)] == 0.5 and rows[("b", 0)] == 1.0 and abs(rows[(None, 1)] - 2 / 3) < 1e-12


def test_query_support_cross_chunked_equals_broadcast(spark):
    q = spark.range(20).select(F.col("id").alias("query"))
    s = spark.range(7).select(F.col("id").alias("support"))
    a = sorted(tuple(r) for r in K.query_support_cross(q, s).collect())
    b = sorted(tuple(r) for r in K.query_support_cross(q, s, max_broadcast_rows=3, queries_per_task=6).collect())
    assert a == b and len(a) == 140


def test_stream_batches_fallback_equals_batch(spark):
    import os
    from kshot.session import shared_dir
    from kshot.streaming.stream import classify_stream_batches
    from tests.conftest import SF001
    base = shared_dir(spark, "t_stream")
    src = base + "/src"
    qs = spark.range(30).select(F.col("id").alias("item_id"),
                                F.array((F.col("id") % 7).cast("float"), (F.col("id") % 5).cast("float")).alias("vec"))
    qs.write.parquet(src)
    sup = spark.range(12).select(F.col("id").cast("int").alias("class_idx"),
                                 F.array((F.col("id") % 4).cast("float"), (F.col("id") % 3).cast("float")).alias("vec"))
    stream = spark.readStream.schema("item_id long, vec array<float>").parquet(src)
    classify_stream_batches(stream, sup, base + "/out", base + "/ckpt", max_broadcast_rows=5)
    got = sorted((r.item_id, r.pred) for r in spark.read.parquet(base + "/out").collect())
    exp = sorted((r.item_id, r.pred) for r in K.nearest_support(spark.read.parquet(src), sup).collect())
    assert got == exp
    _ = (os, SF001)
