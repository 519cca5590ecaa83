"""Queries for the learned heads (H1-H4, H6); Spark ML fits (H1-H4) have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators import halving as M
from kshot.operators import learn as H
from kshot.operators import sampling as D
from kshot.operators import splits as C
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_sampling import _d9_sql, d1_ctes
from kshot.plans.registry import register

SEED = 42


def _train_eval(spark, sf):
    it = fx.items_vec(spark, sf)
    split = C.split_classes(it, 0.8, 7)
    train = C.restrict(it, split, "train")
    valid = C.restrict(it, split, "validation")
    vec = it.select("item_id", "vec")

    def attach(pr):
        return (pr.join(vec.select(F.col("item_id").alias("a"), F.col("vec").alias("va")), "a")
                .join(vec.select(F.col("item_id").alias("b"), F.col("vec").alias("vb")), "b"))
    tr = attach(D.sample_balanced_pairs(train, 50, SEED))
    ep = D.sample_episodes(it, 40, 5, 5, SEED)
    ev = attach(D.episode_query_pairs(ep, it, SEED).withColumnRenamed("support", "a").withColumnRenamed("query", "b"))
    return tr, ev, valid, vec


def _eval_row(model, ev, kind):
    m = H.evaluate_model(model, ev, kind)
    return m.select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@register("fit_logistic_absdiff")
def q_fit_logistic_absdiff(spark, sf):
    tr, ev, _, _ = _train_eval(spark, sf)
    return _eval_row(H.fit_logistic_absdiff(tr, 0.01, 50), ev, "absdiff")


@register("fit_logistic_concat")
def q_fit_logistic_concat(spark, sf):
    tr, ev, _, _ = _train_eval(spark, sf)
    return _eval_row(H.fit_logistic_concat(tr, 0.01, 50), ev, "concat")


@register("fit_mlp")
def q_fit_mlp(spark, sf):
    tr, ev, _, _ = _train_eval(spark, sf)
    return _eval_row(H.fit_mlp(tr, "absdiff", (32, 16), 50), ev, "absdiff")


@register("evaluate_model")
def q_evaluate_model(spark, sf):
    tr, ev, _, _ = _train_eval(spark, sf)
    model = H.fit_mlp(tr, "concat", (32,), 30)
    return _eval_row(model, ev, "concat")


RUNGS, STEPS, CANDIDATES, TASKS = (2, 2, 3), 500, 8, 100


_BCE = "-(label * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - label) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))"


def _halving_sql() -> str:
    """The search spelled out: every scan as a pair of aggregations, every rung as a ranking."""
    drawn = ", ".join(f"{lo} + ({hi} - {lo}) * {S.unif(SEED, '@c.c', name)} AS {name}" for name, lo, hi in H.CONTINUOUS)
    picked = ", ".join(f"list_extract([{', '.join(map(str, map(float, v)))}], ({S.h(SEED, '@c.c', n)} % {len(v)} + 1)::INTEGER) AS {n}"
                       for n, v in H.DISCRETE if n in M.DIMENSIONS)
    split = (f"spl AS (SELECT class, rk <= floor(cc * 0.8) AS train FROM (SELECT class, row_number() OVER (ORDER BY "
             f"{S.md5key(7, '@class')}, class) AS rk, count(*) OVER () AS cc FROM (SELECT DISTINCT label AS class FROM embeddings)))")
    side = "items AS (SELECT vec_id AS item_id, label AS class, embedding AS vec FROM embeddings JOIN spl ON class = label WHERE {}train)"
    ctes = [split, f"cand AS (SELECT c.c AS candidate, {drawn}, {picked} FROM range({CANDIDATES}) c(c))",
            f"prs AS (WITH {d1_ctes(side.format(''))} SELECT row_number() OVER () AS pid, label, a, b FROM d1)",
            f"tsk AS (WITH {_d9_sql(n=2, tasks=TASKS).replace(S.ITEMS_VEC, side.format('NOT '))} SELECT * FROM tasks)"]
    diff = "SELECT {}, unnest(range(0, len(x.embedding) + 1)) AS dim, unnest(list_prepend(1.0, list_transform(range(1, len(x.embedding) + 1), " \
           "lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE)))) AS x FROM {} q JOIN embeddings x ON x.vec_id = q.{} JOIN embeddings y ON y.vec_id = q.{}"
    ctes += [f"xs AS MATERIALIZED ({diff.format('pid, q.label AS label', 'prs', 'a', 'b')})",
             f"ts AS MATERIALIZED ({diff.format('task, pair_no', 'tsk', 'query', 'support')})",
             "s0 AS (SELECT candidate, dim, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM cand, (SELECT DISTINCT dim FROM xs))"]
    t, at_scan, out = 0, "s0", []
    for rung, scans in enumerate(RUNGS):
        for _ in range(scans):
            at = t * STEPS
            rate = f"learning_rate * Dense1_multiplier * {STEPS} * {0.99 ** (at // 500)!r}::DOUBLE"
            momentum = f"(0.5 + momentum_slope * least({at}, greatest(0, ceil(round((momentum - 0.5) / momentum_slope, 9)))))"
            t += 1
            ctes += [f"p{t} AS MATERIALIZED (SELECT candidate, pid, label, 1 / (1 + exp(-sum(w * x))) AS p FROM {at_scan} "
                     "JOIN xs USING (dim) GROUP BY candidate, pid, label)",
                     f"g{t} AS (SELECT candidate, dim, avg((p - p{t}.label) * x) AS g FROM p{t} JOIN xs USING (pid) GROUP BY candidate, dim)",
                     f"s{t} AS MATERIALIZED (SELECT candidate, dim, w + nv AS w, nv AS v FROM (SELECT candidate, dim, w, {momentum} * v "
                     f"- {rate} * (g + CASE WHEN dim > 0 THEN 2 * l2_penalization_Dense1 * w ELSE 0 END) AS nv "
                     f"FROM {at_scan} JOIN g{t} USING (candidate, dim) JOIN cand USING (candidate)))"]
            at_scan = f"s{t}"
        last = rung == len(RUNGS) - 1
        ctes += [f"l{rung} AS (SELECT candidate, avg({_BCE}) AS loss FROM p{t} GROUP BY candidate)",
                 f"o{rung} AS (SELECT candidate, 1 - avg(hit) AS objective FROM (SELECT candidate, task, CASE WHEN first(pair_no ORDER BY "
                 f"round(p, 9) DESC, pair_no) = 0 AND stddev_pop(p) > 0.01 THEN 1 ELSE 0 END AS hit FROM (SELECT candidate, task, pair_no, "
                 f"1 / (1 + exp(-sum(w * x))) AS p FROM {at_scan} JOIN ts USING (dim) GROUP BY candidate, task, pair_no) "
                 "GROUP BY candidate, task) GROUP BY candidate)",
                 f"n{rung} AS (SELECT candidate, sqrt(sum(w * w)) AS weight_norm FROM {at_scan} GROUP BY candidate)",
                 f"r{rung} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY objective, round(loss, 9), candidate) <= "
                 f"{'1' if last else '(n + 1) // 2'} AS kept FROM (SELECT *, count(*) OVER () AS n FROM l{rung} JOIN o{rung} USING (candidate) "
                 f"JOIN n{rung} USING (candidate)))",
                 f"k{rung} AS MATERIALIZED (SELECT s.* FROM {at_scan} s JOIN r{rung} USING (candidate) WHERE kept)"]
        at_scan = f"k{rung}"
        dims = ", ".join(f"{S.r(d, 9)} AS {d}" for d in M.DIMENSIONS)
        out.append(f"SELECT {rung} AS rung, candidate, {dims}, {t * STEPS}::BIGINT AS iterations, {S.r('loss')} AS loss, "
                   f"{S.r('objective')} AS objective, {S.r('weight_norm')} AS weight_norm, kept::INTEGER AS kept, "
                   f"{'kept::INTEGER' if last else '0'} AS is_best FROM r{rung} JOIN cand USING (candidate)")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


@register("search", _halving_sql())
def q_search(spark, sf):
    """H6: candidates of the search space (five drawn dimensions) on training-class pairs, the better half of each rung
    by one-shot accuracy on validation-class tasks."""
    items = fx.items_vec(spark, sf)
    split = C.split_classes(items, 0.8, 7)
    vec = items.select("item_id", "vec")

    def with_vectors(rows, a, b):
        return (rows.join(vec.select(F.col("item_id").alias(a), F.col("vec").alias("va")), a)
                .join(vec.select(F.col("item_id").alias(b), F.col("vec").alias("vb")), b))
    pairs = with_vectors(D.sample_balanced_pairs(C.restrict(items, split, "train"), 50, SEED), "a", "b")
    tasks = with_vectors(D.one_shot_tasks(C.restrict(items, split, "validation"), 2, TASKS, SEED), "query", "support")
    found, _ = M.successive_halving(H.sample_search_space(spark, CANDIDATES, SEED), pairs, tasks, list(RUNGS), STEPS)
    return found.select("rung", "candidate", *[(F.round(d, 9) + F.lit(0.0)).alias(d) for d in M.DIMENSIONS], "iterations",
                        *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("loss", "objective", "weight_norm")], "kept", "is_best")
