"""Joins and positions that must stay spread when a key is hot."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from kshot.operators import joins as J
from kshot.operators import text as B
from kshot.operators.positions import ranged_position
from kshot.operators.splits import draw_support, support_query_split
from kshot.plans import fixtures as fx
from tests.conftest import SF001


def test_hot_key_outside_the_table_is_spread_and_kept(spark):
    rows = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, "the").otherwise(
        F.concat(F.lit("w"), (F.col("id") % 700).cast("string"))).alias("token"))
    table = spark.createDataFrame([(f"w{i}", i) for i in range(0, 700, 2)], "token string, id int")
    got = {(r.r, r.id) for r in J.split_join(rows, table, "token", ["r"], share=100).collect()}
    want = {(r.r, r.id) for r in rows.join(table, "token", "left").collect()}
    assert got == want and len(got) == 3000
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    assert [r.token for r in J.hot_keys(counts, "token", share=100).collect()] == ["the"]


def test_hot_rows_do_not_share_a_partition(spark):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        rows = spark.range(8000).select(F.col("id").alias("r"), F.when(F.col("id") % 2 == 0, 1).otherwise(
            F.col("id").cast("int")).alias("id"))
        table = spark.range(8000).select(F.col("id").cast("int").alias("id"), (F.col("id") * 2).alias("v"))
        out = J.split_join(rows, table, "id", ["r"]).where("id = 1").select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
        assert sum(sizes) >= 4000 and max(sizes) < 2000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_small_join_salts_above_its_bound(spark):
    rows = spark.range(500).select(F.col("id").alias("item"), (F.col("id") % 3).alias("class"))
    table = spark.createDataFrame([(0, "a"), (1, "b")], "class long, name string")
    broad = {tuple(r) for r in J.small_join(rows, table, "class", "item").collect()}
    salted = {tuple(r) for r in J.small_join(rows, table, "class", "item", max_broadcast_rows=1).collect()}
    assert broad == salted and len(broad) == 334


def test_ranged_position_of_tokens_with_one_long_beginning(spark):
    words = sorted("https://example.org/" + "x" * (i % 7) + str(i) for i in range(400))
    df = spark.createDataFrame([(w, 1) for w in words], "token string, cnt long").repartition(5)
    got = {r.token: r.pos for r in ranged_position(df, [F.asc("token")], "pos", rows_per_range=30).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


def test_drawn_support_equals_the_numbered_one_and_no_exchange_carries_vectors(spark):
    items = fx.items_vec(spark, SF001)
    support, queries, _ = draw_support(items, 2, 5)
    tagged, _ = support_query_split(items, 2, 5)
    for part, role in ((support, "support"), (queries, "query")):
        want = {(r.item_id, r.class_idx) for r in tagged.where(F.col("role") == role).collect()}
        assert {(r.item_id, r.class_idx) for r in part.collect()} == want
    out = io.StringIO()
    with redirect_stdout(out):
        queries.select("item_id", "class_idx", "vec").explain()
    shuffles = [x for x in out.getvalue().splitlines() if "Exchange hashpartitioning" in x]
    assert not shuffles


def test_encode_with_a_hot_token_outside_the_vocabulary(spark):
    docs = spark.createDataFrame([(i, ["the", f"w{i % 5}", "the"]) for i in range(60)], "item_id long, tokens array<string>")
    vocab = spark.createDataFrame([(f"w{i}", i + 2) for i in range(4)], "token string, id long")
    for r in B.encode_unk(docs, vocab).collect():
        w = r.item_id % 5
        assert r.ids == [1, w + 2 if w < 4 else 1, 1]


def test_frequent_keys_finds_every_key_over_the_share(spark):
    """5,000 keys over a share of 1/10000-th band around 1/1000, among 300,000 rows of rare ones; nulls do not count."""
    hot = spark.range(40).select(F.explode(F.array_repeat(F.concat(F.lit("h"), "id"), 420)).alias("k"))
    near = spark.range(300).select(F.explode(F.array_repeat(F.concat(F.lit("n"), "id"), 150)).alias("k"))
    rare = spark.range(300_000).select(F.concat(F.lit("r"), "id").alias("k"))
    nulls = spark.range(100_000).select(F.lit(None).cast("string").alias("k"))
    rows = hot.union(near).union(rare).union(nulls).repartition(6)
    got = {r.k for r in J.frequent_keys(rows, "k").collect()}
    assert {f"h{i}" for i in range(40)} <= got and all(k[0] in "hn" for k in got) and len(got) < 1334


def test_frequent_keys_of_numbers_and_of_nothing(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"))
    assert {r.k for r in J.frequent_keys(rows, "k").collect()} == {0, 1}
    assert J.frequent_keys(rows.limit(0), "k").collect() == []
    assert J.frequent_keys(rows.select(F.lit(None).cast("int").alias("k")), "k").collect() == []


def test_split_join_with_nulls_and_array_keys(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("k"))
    table = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted((i, (i % 5) * 10 if i % 3 == 0 and i % 5 < 3 else None) for i in range(500))
    got = J.split_join(rows, table, "k", ["id"], share=20)
    assert sorted((r.id, r.v) for r in got.collect()) == want
    arrays = J.split_join(rows.withColumn("k", F.array("k")), table.withColumn("k", F.array("k")), "k", ["id"], share=20)
    assert sorted((r.id, r.v) for r in arrays.collect()) == want
