"""Queries: shuffled batches over several epochs by a keyed permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.functions.permute import ROUNDS
from kshot.operators import splits as C
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.registry import register

SEED, EPOCHS, BATCH = 42, 3, 32


def _network_sql(x: str, src: str) -> str:
    """Rounds of the network as lateral columns of one select: (item_id, n, a, b, epoch, x)."""
    cols, left, right = [f"{x} % a AS l0", f"{x} // a AS r0"], "l0", "r0"
    for j in range(1, ROUNDS + 1):
        size = "a" if j % 2 else "b"
        cols.append(f"({left} + {S.h(SEED, '@epoch', j, '@' + right)}) % {size} AS t{j}")
        left, right = right, f"t{j}"
    return (f"SELECT item_id, n, a, b, epoch, {left} + {right} * a AS x FROM "
            f"(SELECT *, {', '.join(cols)} FROM {src})")


PERMUTED = f"""n0 AS (SELECT vec_id AS item_id, row_number() OVER (ORDER BY vec_id) - 1 AS number, count(*) OVER () AS n FROM embeddings),
n1 AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM n0),
n2 AS (SELECT *, (n + a - 1) // a AS b, e.e AS epoch FROM n1, range({EPOCHS}) e(e)),
walk AS ({_network_sql('number', 'n2')} UNION ALL {_network_sql('x', 'walk WHERE x >= n')}),
placed AS (SELECT item_id, epoch, x + 1 AS pos, x // {BATCH} AS batch_id, n FROM walk WHERE x < n)"""


def _epochs(spark, sf):
    numbered = C.number_rows(fx.items_vec(spark, sf).select("item_id"), "item_id")
    return C.permuted_epochs(numbered, numbered.count(), SEED, EPOCHS, BATCH)


@register("permuted_epochs", f"""WITH RECURSIVE {PERMUTED}
SELECT item_id, epoch::INTEGER AS epoch, pos::BIGINT AS pos, batch_id::BIGINT AS batch_id FROM placed WHERE batch_id < n // {BATCH}""")
def q_permuted_epochs(spark, sf):
    return _epochs(spark, sf).select("item_id", "epoch", "pos", "batch_id")


@register("permutation_is_bijective", f"""SELECT e.e::INTEGER AS epoch, count(*) AS rows, count(*) AS places, 1::BIGINT AS first,
  count(*) AS last FROM embeddings, range({EPOCHS}) e(e) GROUP BY 1""")
def q_permutation_is_bijective(spark, sf):
    """Every place of every epoch is taken once (batches of one: nothing is dropped)."""
    numbered = C.number_rows(fx.items_vec(spark, sf).select("item_id"), "item_id")
    e = C.permuted_epochs(numbered, numbered.count(), SEED, EPOCHS, 1)
    return e.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pos").alias("places"),
                                  F.min("pos").alias("first"), F.max("pos").alias("last"))
