import pytest
from pyspark.sql import functions as F

from kshot.functions.permute import halves, permuted
from kshot.operators import splits as C


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 97, 1000, 4099])
def test_bijection(spark, n):
    got = spark.range(n).select(permuted(F.col("id"), n, 7, F.lit("e0")).alias("x"), permuted(F.col("id"), n, 7, F.lit("e1")).alias("y")).collect()
    assert sorted(r.x for r in got) == list(range(n)) == sorted(r.y for r in got)
    if n > 90:
        assert [r.x for r in got] != [r.y for r in got] and sum(r.x == i for i, r in enumerate(got)) < 12
    a, b = halves(n)
    assert 0 <= a * b - n < a


def test_places_are_uniform(spark):
    """Where number 0 goes over many keys: each of ten tenths gets its share."""
    got = spark.range(3000).select(permuted(F.lit(0), 1000, 3, F.col("id")).alias("x")).groupBy(F.floor(F.col("x") / 100)).count().collect()
    assert len(got) == 10 and all(220 < r["count"] < 380 for r in got)


def test_outside_is_null_and_numbers_are_dense(spark):
    got = spark.createDataFrame([(-1,), (5,), (None,)], "id long").select(permuted(F.col("id"), 5, 1)).collect()
    assert [r[0] for r in got] == [None] * 3
    rows = spark.createDataFrame([(i * 70_000 % 1_000_003,) for i in range(50)] + [(None,), (-5,)], "k long").repartition(4)
    num = C.number_rows(rows, "k", per_bucket=1 << 10).orderBy("number").collect()
    assert [r.number for r in num] == list(range(52)) and [r.k for r in num[:2]] == [None, -5]
    assert [r.k for r in num[1:]] == sorted(r.k for r in num[1:])


def test_no_exchange_after_the_numbering(spark):
    num = C.number_rows(spark.range(100).withColumnRenamed("id", "k"), "k")
    plan = C.permuted_epochs(num, 100, 1, 4, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    got = C.permuted_epochs(num, 100, 1, 4, 8).groupBy("epoch", "batch_id").count().collect()
    assert len(got) == 4 * 12 and all(r["count"] == 8 for r in got)
