"""Draws meet the class table on salted keys above the broadcast bound: same rows, no key gathers all draws."""

import pytest
from pyspark.sql import functions as F

from kshot.operators import sampling as D
from kshot.plans import fixtures as fx
from tests.conftest import SF001


def scoped(spark):
    return fx.items_text(spark, SF001).select("item_id", "superclass", "class")


def vec(spark):
    return fx.items_vec(spark, SF001).select("item_id", "class")


SAMPLERS = {
    "D2": lambda s, b: D.sample_train_batch_scoped(scoped(s), 8, 6, 1, max_broadcast_rows=b),
    "D3": lambda s, b: D.sample_train_batch(vec(s), 8, 6, 1, max_broadcast_rows=b),
    "D4": lambda s, b: D.sample_episodes(vec(s), 10, 3, 2, 1, max_broadcast_rows=b),
    "D4 distinct": lambda s, b: D.sample_episodes(vec(s), 10, 3, 2, 1, replace=False, max_broadcast_rows=b),
    "D6": lambda s, b: D.episode_query_pairs(D.sample_episodes(vec(s), 10, 3, 2, 1, max_broadcast_rows=b), vec(s), 1,
                                                 max_broadcast_rows=b),
    "D8": lambda s, b: D.one_shot_tasks_scoped(scoped(s), 4, 5, 1, max_broadcast_rows=b),
    "D8 all": lambda s, b: D.one_shot_tasks_scoped(scoped(s), -1, 5, 1, max_broadcast_rows=b),
    "D9": lambda s, b: D.one_shot_tasks(vec(s), 4, 20, 1, max_broadcast_rows=b),
}


@pytest.mark.parametrize("name", SAMPLERS)
def test_salted_class_joins_give_the_same_rows(spark, name):
    wide, narrow = SAMPLERS[name](spark, 200_000), SAMPLERS[name](spark, 0)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, narrow.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line and any(k in line for k in ("cidx", "class_idx", "sidx", "oidx"))]
    assert all("_salt" in line for line in joins) and "Cross" not in plan


def test_all_draws_of_one_superclass_are_spread(spark):
    """D3 has one superclass: its rows reach the class join under many salts."""
    rows = D.sample_train_batch(vec(spark), 64, 4, 1, max_broadcast_rows=0)
    assert rows.select("step", "draw").distinct().count() == 256
    assert rows.groupBy("pair_no").count().where(F.col("count") == 256).count() == 2
