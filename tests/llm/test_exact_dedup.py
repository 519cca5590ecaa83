"""Operator 13 against brute force, the perfect hash as a bijection, edge rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kshot.llm import exact_dedup as E

SPACE = {ord(c): None for c in E.SPACE}
#: Every name that the operator uses inside, as extra columns of the input.
CLASH = ("rid long, id string, digest string, code_points int, old int, n int, best string, shard int, slot int, "
         "seeds int, kept int, keep_id long, group_size int, text string, doc_id {}")


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    keys = [t.translate(SPACE) for _, t in rows]
    out = []
    for (i, _t), k in zip(rows, keys, strict=True):
        same = [rows[j] for j in range(len(rows)) if keys[j] == k]
        best = min(same, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        out.append((i, best[0], len(same), hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, kind="long", history=None, clash=True):
    if clash:
        df = spark.createDataFrame([(1, "x", "y", 2, 3, 4, "b", 5, 6, 7, 8, 9, 10, t, i) for i, t in rows], CLASH.format(kind))
    else:
        df = spark.createDataFrame([(i, t) for i, t in rows], f"doc_id {kind}, text string")
    got = E.dedup(df.repartition(5), history)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return got.collect()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 6))) for _ in range(400)]
    return [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "hot\ttext" + " " * (i % 7)) for i in range(300)]


@pytest.mark.parametrize("history", [None, "even", "all"])
def test_equals_brute_force(spark, rows, history):
    cond = {None: None, "even": F.col("doc_id") % 2 == 0, "all": F.lit(True)}[history]
    got = run(spark, rows, history=cond)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == brute(rows)
    assert {r.doc_id for r in got if r.kept} == {r.keep_id for r in got}


def test_edge_rows_nulls_repeats_long_text(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (4, "a b"), (4, "a b"), (None, "ab"), (None, "q"),
            (5, "é" * 300_000), (6, "é " * 300_000), (7, "a\x1fb"), (8, "a b"), (8, "other")]
    got = run(spark, rows, history=F.col("doc_id") < 5)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].keep_id == 3 and by[5].keep_id == 6 and by[7].group_size == 1


def test_empty_tables_and_string_ids(spark):
    assert run(spark, []) == []
    got = run(spark, [("b", "x y"), ("a", "xy "), ("c", "z")], kind="string", clash=False)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1500])
def test_perfect_hash_is_a_bijection_and_knows_nonmembers(n):
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(2 * n)), "<u8").reshape(-1, 4)
    seeds, slot = E.place(words[:n])
    assert sorted(slot) == list(range(n))
    slots = np.empty_like(words[:n])
    slots[slot] = words[:n]
    assert (E.lookup(words[:n], seeds, slots) == slot).all()
    assert (E.lookup(words[n:], seeds, slots) == -1).all()
    assert (E.lookup(words, seeds[:0], slots[:0]) == -1).all()
