"""The sweep runs at the reference's sizes and, over larger tables, draws as often as there are items."""

import duckdb
from pyspark.sql import functions as F

from kshot.operators import sampling as D
from kshot.plans import catalog  # noqa: F401  (registers every query)
from kshot.plans.registry import ORACLE, QUERIES
from kshot.session import local_path, shared_dir


def _twin(path: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{local_path(path)}/documents.parquet/*.parquet')")
    return sorted(con.execute(ORACLE["scale_sweep"]).fetchall())


def _documents(spark, n: int) -> str:
    path = shared_dir(spark, "t_sweep")
    (spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" x y x w"), F.col("id") % 7).alias("text"),
                           F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("id") % 2 + 1).cast("int")).alias("lang"),
                           F.concat(F.lit("src"), F.col("id") % 10).alias("source"))
     .repartition(3).write.parquet(f"{path}/documents.parquet"))
    return path


def test_sweep_runs_at_the_sizes_of_the_reference(spark):
    path = _documents(spark, 400)
    got = sorted(tuple(r) for r in QUERIES["scale_sweep"](spark, path).collect())
    assert [r[:2] for r in got] == [(100, 30_000), (200, 60_000), (300, 90_000)]
    assert got == _twin(path)


def test_sweep_grows_with_the_table(spark):
    path = _documents(spark, 9_010)
    got = sorted(tuple(r) for r in QUERIES["scale_sweep"](spark, path).collect())
    assert [r[0] for r in got] == [100, 200, 300, 361] and got[-1][3] > 5_000
    assert got == _twin(path)
    assert D.sweep_sizes([1, 2], 25, 50) == [1, 2] and D.sweep_sizes([1, 2], 25, 51) == [1, 2, 3]


def test_sweep_is_the_same_without_broadcast(spark):
    items = spark.read.parquet(f"{_documents(spark, 600)}/documents.parquet").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("class"), "text")
    tokens = F.split("text", " ")
    ways = [sorted(map(tuple, D.scale_sweep(items, tokens, [2, 5], 30, 3, 4, 1, bound).collect())) for bound in (1_000_000, 1)]
    assert ways[0] == ways[1] and [r[:2] for r in ways[0]] == [(2, 60), (5, 150)]
