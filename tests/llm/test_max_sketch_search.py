"""Operator 11 against brute force, bounds above scores, edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import words

from kshot.llm import max_sketch_search as S

#: Names that the operator uses inside, as extra columns of both inputs.
DOCS = ("key long, id string, n int, sketch string, df int, bounds int, asked int, top int, query int, rank int, "
        "score int, _k int, _id int, _text int, text string, doc_id {}")
ITEMS = "row int, item string, body string, query int, rank int, text string, item_id long"


def brute(docs, items, k):
    bags = [Counter(words(t)) for _, t in docs]
    n = [sum(b.values()) for b in bags]
    nd, nt = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag, size in zip(docs, bags, n, strict=True):
            s = 0
            for t in words(text):
                if bag[t]:
                    m = 75 + 25 * size * nd // nt
                    s += math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (
                        10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if s > 0:
                scored.append((-s, doc is None, doc if doc is not None else 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=20, kind="long", **more):
    d = spark.createDataFrame([(1, "i", 2, "s", 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, t, i) for i, t in docs], DOCS.format(kind))
    q = spark.createDataFrame([(1, "a", "b", 2, 3, t, i) for i, t in items], ITEMS)
    got = S.search(d.repartition(5), q.repartition(2), k, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    lexicon = [f"{rng.choice('abcé')}{i}" for i in range(600)]
    weights = [1 / (i + 1) for i in range(600)]
    def text(n):
        return " ".join(rng.choices(lexicon, weights, k=n)).upper() if n % 5 == 0 else ", ".join(rng.choices(lexicon, weights, k=n))
    docs = [(i, text(rng.randint(0, 120))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(120)]       # copies: ties at every rank
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(100, docs[3][1]), (101, "nowhere"), (102, "a0 a0 b1 A0")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20, 1000])
def test_equals_brute_force(spark, corpus, k):
    assert run(spark, *corpus, k=k) == brute(*corpus, k)


def test_blocks_of_queries_and_shuffled_candidates(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "MAX_BYTES", -1)
    assert run(spark, *corpus, k=5, block_bytes=1500) == brute(*corpus, 5)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 64)          # every longer text is cut into sections
    docs = [(1, None), (2, ""), (3, "!!"), (4, "a b c"), (4, "a b c"), (4, "a c"), (None, "a b c"), (None, "b"),
            (5, "x" * 500 + " a " * 300), (6, ("a b " * 2000) + "q"), (7, "é à É")]
    items = [(1, "A b"), (1, "a B"), (2, None), (3, "?"), (None, "c q é"), (5, "É"), (6, "zzz")]
    assert run(spark, docs, items) == brute(docs, items, 20)
    assert run(spark, docs, items, k=2) == brute(docs, items, 2)


def test_empty_tables_and_string_ids(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == [] and run(spark, [(1, "a")], [(1, None)]) == []
    docs = [("b", "q w"), ("a", "q w"), ("c", "w w")]
    assert [(r[1], r[2]) for r in run(spark, docs, [(1, "q")], kind="string")] == [(1, "a"), (2, "b")]


def test_bounds_are_never_below_scores_and_mostly_tight():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(200)) + " w7" * rng.choice([0, 1, 140, 3000]) for _ in range(60)]
    block = S.Queries([" ".join(f"w{rng.randint(0, 5000)}" for _ in range(30)) for _ in range(20)])
    block.weigh(60, 60 * 200, {t: 1 for t in range(block.size)})
    col = pa.array(texts)
    (_, _, parts), = S._runs(col)
    n = pa.array(parts[0].count)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), n, S.sketches(parts, 60)], names=list("abcd"))
    (_, _, bounds), = S._bounds([batch], block)
    doc, term, tf = block.hits(parts[0])
    for d in range(60):
        exact = np.zeros(block.size, np.int64)
        exact[term[doc == d]] = tf[doc == d]
        true = block.total(S.impact(exact, block.length_norm(int(parts[0].count[d]))))
        assert (bounds[d] >= true).all()
        assert (bounds[d] == true).mean() > 0.4
