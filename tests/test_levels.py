"""Positions and running maxima through levels of buckets equal plain windows; classes above the bound are ranged."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kshot.operators import positions as P
from kshot.operators.labels import label_index
from kshot.operators.splits import split_classes


@pytest.mark.parametrize("fan", [2, 3, 4096])
def test_positions_through_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(P, "FAN", fan)
    df = spark.range(500).select(((F.col("id") * 37) % 211 - 40).alias("b"), "id").repartition(4)
    got = P.global_position(df, [F.col("b"), F.col("id")], [F.col("b")], "pos").collect()
    want = sorted((r.b, r.id) for r in df.collect())
    assert sorted((r.pos, r.b, r.id) for r in got) == [(i + 1, b, x) for i, (b, x) in enumerate(want)]


@pytest.mark.parametrize("fan", [2, 5, 4096])
def test_running_maxima_through_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(P, "FAN", fan)
    df = spark.range(400).select((F.col("id") % 3).alias("run"), F.floor(F.col("id") / 3).alias("it"),
                                 ((F.col("id") * 7919) % 503 + F.col("id")).alias("v")).repartition(3)
    got = P.running_max_before(df, F.col("v"), [F.col("it")], [F.floor(F.col("it") / 4)], "m", ["run"])
    plain = F.max("v").over(Window.partitionBy("run").orderBy("it").rowsBetween(Window.unboundedPreceding, -1))
    want = df.withColumn("m", plain)
    cols = ["run", "it", "v", "m"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)


def test_no_window_over_all_buckets(spark):
    df = spark.range(100).select(F.col("id").alias("b"), "id")
    plan = P.global_position(df, [F.col("id")], [F.col("b")], "pos")._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window" in line and "], [_b0" not in line and "], [_up" not in line and "[_b0" not in line]
    assert all("_up" in line for line in alone)


def test_many_classes_are_ranged(spark):
    items = spark.range(900).select(F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("class"), F.col("id").alias("item_id"))
    plain, ranged = (sorted(map(tuple, label_index(items, max_rows=n).collect())) for n in (1000, 10))
    assert plain == ranged and [c for c, _ in plain] == sorted(c for c, _ in plain) and len(plain) == 300
    a, b = (sorted(map(tuple, split_classes(items, 0.6, 3, max_rows=n).collect())) for n in (1000, 10))
    assert a == b and sum(s == "train" for _, s in a) == 180
