"""Operator 12 against brute force (with and without extension of prefixes), exact arithmetic, edge rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kshot.llm import phrase_mining as P

#: Names that the operator uses inside, as extra columns of the input.
DOCS = ("h long, n int, p string, f int, word int, part int, key int, a int, l int, r int, k int, score int, rank int, "
        "phrase int, g int, doc_id long, text string, lang string")


def brute(rows, min_count, top):
    out = []
    by_lang = defaultdict(list)
    for text, lang in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        by_lang["und" if lang is None else lang] += [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", t)]
    for lang, pieces in by_lang.items():
        f = Counter(tuple(w[i:i + k]) for w in pieces for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in pieces)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = defaultdict(int)
        for q, a in cand.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    inside[q[i:i + k]] = max(inside[q[i:i + k]], a)
        kept = []
        for p, a in cand.items():
            if 100 * inside[p] >= 100 * a:
                continue
            s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(1, 2, "p", 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, t, x) for t, x in rows], DOCS).repartition(4)
    got = P.mine(df, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    lexicon = [f"{c}{i}" for i in range(12) for c in "aBé"]
    def text():
        w = rng.choices(lexicon, [1 / (i + 1) for i in range(len(lexicon))], k=rng.randint(0, 60))
        return "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "'"]) for x in w)
    out = [(text(), rng.choice(["en", "fr", None, "und"])) for _ in range(300)]
    return out + [("the very same passage of eight words here; a a a a a a a", "en")] * 150


@pytest.mark.parametrize("budget", [1_000_000, 400, 20])
def test_equals_brute_force(spark, rows, budget):
    want = brute(rows, 6, 40)
    assert len(want) > 60 and run(spark, rows, min_count=6, top=40, budget=budget) == want


def test_prefixes_over_budget_are_extended(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    words = P.count_words(df).groupBy("h").sum("n")
    _, borders, over, _ = P.partition(df, P.bitmap(words, "h", words.count()), 10, 60)
    assert len(over[2]) and len(over[3]) and len(over[4]) and len(borders) > 3


def test_sections_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 100)
    rows = [("a b c, d e. " * 400 + "x" * 300 + " y;" + "q r " * 300, "en"), ("a b", "en"), (None, "en"), ("", None), ("?!.", "fr")]
    assert run(spark, rows, min_count=5, top=50) == brute(rows, 5, 50)


def test_empty_and_rare(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("", "en")]) == []
    assert run(spark, [("a b c", "en")] * 99) == []
    assert run(spark, [("a b", None)] * 60 + [("A  B", "und")] * 40) == [("und", 1, "a b", 100, 100, 100, 200, 2000)]


def test_arithmetic_beyond_64_bits(spark):
    big = 4 * 10**15
    row = spark.createDataFrame([(big, 7 * 10**15, big + 1, big + 3)], "a long, n long, l long, r long") \
        .select(P._score("a", "n", "l", "r").alias("s")).first()
    assert row.s == 1000 * big * 7 * 10**15 // ((big + 1) * (big + 3))


def test_subtree_counts_leaves():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 3, (P.MAX_WORDS, 200)).astype(np.uint64)
    for i in range(200):
        words[rng.integers(2, P.MAX_WORDS + 1):, i] = 0
    times = rng.integers(1, 9, 200)
    got = {tuple(node[:, i].tolist()): int(n[i]) for _, node, n in P.subtree(words, times) for i in range(len(n))}
    want = Counter()
    for i in range(200):
        s = [x for x in words[:, i].tolist() if x]
        for d in range(2, len(s) + 1):
            want[tuple(s[:d])] += int(times[i])
    assert got == want
