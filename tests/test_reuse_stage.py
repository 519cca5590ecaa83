"""A stage is found again by plan and input files, and rebuilt when either changed or the write did not end."""

import os

from pyspark.sql import functions as F

from kshot.session import local_path, shared_dir
from kshot.sources import files as A


def source(spark, n=10):
    path = shared_dir(spark, "reuse_in")
    spark.range(n, numPartitions=2).select("id", F.array("id").alias("v")).write.parquet(path)
    return path


def plan(spark, path, limit=5):
    return spark.read.parquet(path).where(F.col("id") < limit).select((F.col("id") + 1).alias("x"), F.transform("v", lambda x: x + 1).alias("v"))


def test_same_plan_and_files_are_found_again(spark):
    path, root = source(spark), shared_dir(spark, "reuse")
    a = A.reuse_stage(plan(spark, path), root, "s")
    b = A.reuse_stage(plan(spark, path), root, "s")
    assert sorted(a.inputFiles()) == sorted(b.inputFiles()) and b.count() == 5
    assert A.stage_key(plan(spark, path)) == A.stage_key(plan(spark, path)) != A.stage_key(plan(spark, path), "2")


def test_changed_plan_or_schema_is_another_stage(spark):
    path = source(spark)
    keys = {A.stage_key(d) for d in (plan(spark, path), plan(spark, path, 6), plan(spark, path).select("v", "x"),
                                     plan(spark, path).withColumnRenamed("x", "y"), plan(spark, source(spark)))}
    assert len(keys) == 5


def test_changed_or_added_file_is_another_stage(spark):
    path, root = source(spark), shared_dir(spark, "reuse")
    assert A.reuse_stage(plan(spark, path), root, "s").count() == 5
    before = A.stage_key(plan(spark, path))
    part = next(f for f in os.scandir(local_path(path)) if f.name.startswith("part"))
    os.utime(part.path, (1, 1))
    touched = A.stage_key(plan(spark, path))
    spark.range(3).select("id", F.array("id").alias("v")).write.mode("append").parquet(path)
    assert len({before, touched, A.stage_key(plan(spark, path))}) == 3
    assert A.reuse_stage(plan(spark, path), root, "s").count() == 8


def test_torn_write_is_made_again(spark):
    path, root = source(spark), shared_dir(spark, "reuse")
    stage = local_path(f"{root}/s/{A.stage_key(plan(spark, path))}")
    A.reuse_stage(plan(spark, path), root, "s")
    os.remove(f"{stage}/_SUCCESS")
    for f in os.listdir(stage):
        if f.startswith("part"):
            open(f"{stage}/{f}", "wb").close()             # what a lost writer may leave
    assert A.reuse_stage(plan(spark, path), root, "s").count() == 5


def test_plans_without_files(spark):
    assert A.stage_key(spark.range(5)) == A.stage_key(spark.range(5)) != A.stage_key(spark.range(6))
