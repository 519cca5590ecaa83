"""Large distances, selection probability, empty draws, hot classes, multi-file streams, wide episodes."""

import time

import numpy as np
from pyspark.sql import functions as F

from kshot.operators import augment as AU
from kshot.operators import sampling as D
from kshot.operators.classify import nearest_support
from kshot.operators.positions import member_index
from kshot.operators.runlog import early_stop
from kshot.session import shared_dir
from kshot.sources import files as A
from kshot.streaming.stream import parquet_stream


def test_nearest_support_at_768_dimensions(spark):
    rng = np.random.default_rng(1)
    sup, q = rng.normal(size=(5, 768)), rng.normal(size=(40, 768))
    s = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sup)], "class_idx int, vec array<double>")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "item_id long, vec array<double>")
    want = np.abs(q[:, None] - sup[None]).sum(axis=2).argmin(axis=1)
    for kw in ({}, {"max_broadcast_rows": 2}):
        got = {r.item_id: r.pred for r in nearest_support(d, s, **kw).collect()}
        assert [got[i] for i in range(40)] == want.tolist()


def test_augmentation_probability(spark):
    pairs = spark.range(1000).withColumn("key", F.col("id").cast("string"))
    n = AU.augmentation_plan(pairs, "key", 1, AU.Ranges(probability=0.1)).count()
    assert 0.08 < n / 8000 < 0.12


def test_no_draws_for_zero(spark):
    assert spark.range(3).withColumn("x", D._seq(0)).count() == 0


def test_member_index_spreads_a_hot_class(spark):
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.when(F.col("id") < 2500, 0).otherwise(1).alias("class"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        idx = member_index(items, 3, rows_per_bucket=100)
        plan = idx.items._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        got = idx.items.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[:plan.index("SortMergeJoin", plan.index("Window"))]
    assert "hashpartitioning(class#" in above[above.index("Window"):] and "_b0" in above[above.index("Window"):]
    for c, n in ((0, 2500), (1, 500)):
        assert sorted(r.member_idx for r in got if r["class"] == c) == list(range(n))


def test_early_stop_counts_from_the_first_iteration(spark):
    log = spark.createDataFrame([(1, i, 0.0) for i in range(1, 9)], "run int, iteration long, validation double")
    assert early_stop(log, 3).collect()[0].stop_iteration == 5


def test_stream_reads_every_part_file(spark):
    base = shared_dir(spark, "t_parts")
    spark.range(500).repartition(4).write.parquet(f"{base}/events.parquet")
    out, ckpt = shared_dir(spark, "t_out"), shared_dir(spark, "t_ckpt")
    q = (parquet_stream(spark, base, "events", "id long").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 500


def test_twenty_way_episodes_plan_fast(spark):
    items = spark.range(800).select(F.col("id").alias("item_id"), (F.col("id") % 40).alias("class"))
    t = time.time()
    ep = D.sample_episodes(items, 5, 20, 5, seed=2, replace=False)
    ep._jdf.queryExecution().executedPlan()
    assert time.time() - t < 20
    rows = ep.collect()
    assert len(rows) == 500 and len({(r.episode, r.item_id) for r in rows}) == 500


def test_word_vectors_keep_line_breaks(spark):
    path = shared_dir(spark, "t_vec")
    toks = ["a\nb", "c\\n", "d\\", "e\r", "f"]
    A.write_word_vectors(spark.createDataFrame([(t, [1.0, 2.0]) for t in toks], "token string, vector array<double>"), path, 2)
    assert sorted(r.token for r in A.load_word_vectors(spark, path, 2).collect()) == sorted(toks)


def test_stage_recovers_from_a_failed_write(spark):
    import os

    from kshot.session import local_path
    path = shared_dir(spark, "t_half")
    os.makedirs(local_path(path))
    open(local_path(path) + "/part-0.parquet", "w").close()
    assert A.materialize_once(spark, path, lambda: spark.range(7)).count() == 7
