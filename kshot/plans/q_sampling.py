"""Queries: splits, shuffles, batches (C1-C5) and pair / episode / task sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.operators import sampling as D
from kshot.operators import splits as C
from kshot.operators.positions import global_position
from kshot.operators.text import tokenize
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.registry import register

SEED = 42
MI = S.member_cte(SEED)


# ---------------------------------------------------------------- C1-C5
@register("split_classes", f"""WITH {S.ITEMS_TEXT},
c AS (SELECT DISTINCT class FROM items),
r AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(7, '@class')}, class) AS rk, count(*) OVER () AS cc FROM c)
SELECT class, CASE WHEN rk <= floor(cc * 0.8) THEN 'train' ELSE 'validation' END AS split FROM r""")
def q_split_classes(spark, sf):
    return C.split_classes(fx.items_text(spark, sf), 0.8, 7)


@register("background_evaluation", f"""WITH {S.ITEMS_TEXT},
c AS (SELECT DISTINCT class FROM items),
r AS (SELECT class, row_number() OVER (ORDER BY {S.md5key(11, '@class')}, class) AS rk, count(*) OVER () AS cc FROM c)
SELECT i.item_id, i.class, CASE WHEN rk <= floor(cc * 0.6) THEN 'background' ELSE 'evaluation' END AS split
FROM items i JOIN r USING (class)""")
def q_background_evaluation(spark, sf):
    return C.background_evaluation(fx.items_text(spark, sf), 0.6, 11).select("item_id", "class", "split")


def _pairs_sql(E=100, P=300, way=5, shot=5, seed=SEED) -> str:
    """CTEs producing ep (D4 on embeddings) and pr."""
    return f"""{S.ITEMS_VEC}, {MI}, {S.label_cte()},
cc AS (SELECT count(*) AS C FROM lab),
w AS (SELECT e.e AS episode, w.w AS way, lab.class, mi_n.n,
      FROM range({E}) e(e), range({way}) w(w), cc, lab, (SELECT DISTINCT class, n FROM mi) mi_n
      WHERE lab.class_idx = {S.idx('cc.C', seed, '@e.e', '@w.w', 'c')} AND mi_n.class = lab.class),
s AS (SELECT episode, way, s.s AS shot, class, {S.idx('n', seed, '@episode', '@way', '@s.s', 's')} AS member_idx
      FROM w, range({shot}) s(s)),
ep AS (SELECT s.episode, s.way * {shot} + s.shot AS slot, s.way, s.shot, s.class, s.member_idx, mi.item_id
       FROM s JOIN mi USING (class, member_idx)),
pd AS (SELECT e.episode, p.p AS pair_no, {S.idx(way * shot, seed, '@e.episode', '@p.p', 'a')} AS sa,
       {S.idx(way * shot, seed, '@e.episode', '@p.p', 'b')} AS sb
       FROM (SELECT DISTINCT episode FROM ep) e, range({P}) p(p)),
pr AS (SELECT pd.episode, pd.pair_no, a.item_id AS a, b.item_id AS b, CASE WHEN a.class = b.class THEN 1 ELSE 0 END AS label
       FROM pd JOIN ep a ON a.episode = pd.episode AND a.slot = pd.sa JOIN ep b ON b.episode = pd.episode AND b.slot = pd.sb)"""


def _pairs(spark, sf, E=100, P=300, way=5, shot=5, items=None):
    items = items if items is not None else fx.items_vec(spark, sf)
    ep = D.sample_episodes(items, E, way, shot, SEED)
    return ep, D.episode_pairs(ep, P, SEED, way * shot)


@register("positional_split", f"""WITH {_pairs_sql()},
ps AS (SELECT episode, pair_no, row_number() OVER (ORDER BY episode, pair_no) AS pos, count(*) OVER () AS nn FROM pr)
SELECT episode::BIGINT AS episode, pair_no::INTEGER AS pair_no, pos::BIGINT AS pos,
  CASE WHEN pos <= floor(floor(nn * 0.8) * 0.8) THEN 'train' WHEN pos <= floor(nn * 0.8) THEN 'validation'
       ELSE 'unused' END AS part FROM ps""")
def q_positional_split(spark, sf):
    _, pr = _pairs(spark, sf)
    pos = global_position(pr, [F.col("episode"), F.col("pair_no")], [F.col("episode")], "pos")
    return C.positional_split(pos, "pos").select("episode", "pair_no", "pos", "part")


@register("shuffle", f"""SELECT vec_id AS item_id,
  row_number() OVER (ORDER BY {S.md5key(SEED, '@vec_id')}, vec_id)::BIGINT AS pos FROM embeddings""")
def q_shuffle(spark, sf):
    return C.shuffle(fx.items_vec(spark, sf), SEED, "item_id").select("item_id", "pos")


@register("minibatches", f"""WITH p AS (SELECT vec_id AS item_id,
  row_number() OVER (ORDER BY {S.md5key(SEED, '@vec_id')}, vec_id) AS pos, count(*) OVER () AS nn FROM embeddings)
SELECT item_id, pos::BIGINT AS pos, ((pos - 1) // 32)::BIGINT AS batch_id FROM p WHERE (pos - 1) // 32 < nn // 32""")
def q_minibatches(spark, sf):
    sh = C.shuffle(fx.items_vec(spark, sf), SEED, "item_id")
    return C.minibatches(sh, 32, "pos").select("item_id", "pos", "batch_id")


# ---------------------------------------------------------------- D1
_d1_chain, _d1_last = S.distinct_chain("d0", "n", 3, SEED, ("@class", "@round"))


def d1_ctes(items_cte: str, m: int = 50, seed=SEED) -> str:
    """CTEs ending in ``d1`` = D1 pairs (class, round, pair_no, a, b, label)."""
    return f"""{items_cte}, {MI},
cls AS (SELECT class, count(*) AS n FROM items GROUP BY class),
{S.offsets_cte('cls')},
tot AS (SELECT sum(n) AS NN FROM cls),
g AS (SELECT off.off + mi.member_idx AS gpos, mi.item_id FROM mi JOIN off USING (class)),
d0 AS (SELECT off.class, t.r::INTEGER AS round, off.n, off.off, tot.NN FROM off, tot, range({m}) t(r) WHERE off.n >= 3),
{_d1_chain},
d AS (SELECT class, round, off + x0 AS p0, off + x1 AS p1, off + x2 AS p2,
      CASE WHEN gg >= off THEN gg + n ELSE gg END AS p3
      FROM (SELECT *, {S.idx('NN - n', seed, '@class', '@round', 'neg')} AS gg FROM {_d1_last})),
d1 AS (SELECT d.class, d.round, 0 AS pair_no, a.item_id AS a, b.item_id AS b, 1 AS label
  FROM d JOIN g a ON a.gpos = d.p0 JOIN g b ON b.gpos = d.p1
UNION ALL
SELECT d.class, d.round, 1 AS pair_no, a.item_id AS a, b.item_id AS b, 0 AS label
  FROM d JOIN g a ON a.gpos = d.p2 JOIN g b ON b.gpos = d.p3)"""


@register("sample_balanced_pairs", f"WITH {d1_ctes(S.ITEMS_TEXT)} SELECT * FROM d1")
def q_sample_balanced_pairs(spark, sf):
    return D.sample_balanced_pairs(fx.items_text(spark, sf), 50, SEED)


_NEG3 = ["neg", "neg1", "neg2"]


@register("sample_balanced_pairs_neg3", f"""WITH {d1_ctes(S.ITEMS_TEXT, 20)},
dn AS (SELECT class, round, off + x2 AS p2, j, CASE WHEN gg >= off THEN gg + n ELSE gg END AS p3 FROM (
  {' UNION ALL '.join(f"SELECT *, {1 + j} AS j, {S.idx('NN - n', SEED, '@class', '@round', k)} AS gg FROM {_d1_last}"
                      for j, k in enumerate(_NEG3))}))
SELECT * FROM d1 WHERE pair_no = 0
UNION ALL SELECT dn.class, dn.round, dn.j AS pair_no, a.item_id AS a, b.item_id AS b, 0 AS label
FROM dn JOIN g a ON a.gpos = dn.p2 JOIN g b ON b.gpos = dn.p3""")
def q_sample_balanced_pairs_neg3(spark, sf):
    """D1 with three negatives a round."""
    return D.sample_balanced_pairs(fx.items_text(spark, sf), 20, SEED, neg_samples=3)


# ---------------------------------------------------------------- D2 / D3
def _scoped_sql(items_cte: str, B: int, steps: int, min_n: int = 3, seed=SEED) -> str:
    ch, last = S.distinct_chain("st2", "n", 3, seed, ("@step", "@draw"))
    return f"""{items_cte}, {MI},
el AS (SELECT * FROM mi WHERE n >= {min_n}),
cl0 AS (SELECT DISTINCT superclass, class, n FROM el),
cl1 AS (SELECT *, row_number() OVER (PARTITION BY superclass ORDER BY class) - 1 AS cidx,
        count(*) OVER (PARTITION BY superclass) AS cs FROM cl0),
cl AS (SELECT * FROM cl1 WHERE cs >= 2),
sp AS (SELECT superclass, row_number() OVER (ORDER BY superclass) - 1 AS sidx, count(*) OVER () AS SS
       FROM (SELECT DISTINCT superclass FROM cl)),
st0 AS (SELECT t.s AS step, d.d::INTEGER AS draw, sp.superclass
        FROM range({steps}) t(s), range({B}) d(d), sp WHERE sp.sidx = t.s % sp.SS),
st1 AS (SELECT st0.*, (SELECT any_value(cs) FROM cl WHERE cl.superclass = st0.superclass) AS cs FROM st0),
st2 AS (SELECT st1.step, st1.draw, st1.superclass, st1.cs, cl.class, cl.n, cl.cidx FROM st1 JOIN cl
        ON cl.superclass = st1.superclass AND cl.cidx = {S.idx('st1.cs', seed, '@st1.step', '@st1.draw', 'c')}),
{ch},
st3 AS (SELECT *, CASE WHEN o >= cidx THEN o + 1 ELSE o END AS ocidx
        FROM (SELECT *, {S.idx('cs - 1', seed, '@step', '@draw', 'o')} AS o FROM {last})),
st4 AS (SELECT st3.*, cl.class AS oclass, {S.idx('cl.n', seed, '@st3.step', '@st3.draw', 'm')} AS m3
        FROM st3 JOIN cl ON cl.superclass = st3.superclass AND cl.cidx = st3.ocidx),
res AS (SELECT st4.step, st4.draw, st4.superclass, a.item_id AS i0, b.item_id AS i1, c.item_id AS i2, e.item_id AS i3
        FROM st4 JOIN el a ON a.class = st4.class AND a.member_idx = st4.x0
        JOIN el b ON b.class = st4.class AND b.member_idx = st4.x1
        JOIN el c ON c.class = st4.class AND c.member_idx = st4.x2
        JOIN el e ON e.class = st4.oclass AND e.member_idx = st4.m3)"""


@register("sample_train_batch_scoped", f"""WITH {_scoped_sql(S.ITEMS_TEXT, 16, 40)}
SELECT step, draw, 0 AS pair_no, superclass, i0 AS a, i1 AS b, 1 AS label FROM res
UNION ALL SELECT step, draw, 1 AS pair_no, superclass, i2 AS a, i3 AS b, 0 AS label FROM res""")
def q_sample_train_batch_scoped(spark, sf):
    return D.sample_train_batch_scoped(fx.items_text(spark, sf), 16, 40, SEED)


_TRAIN_VEC = f"""items AS (SELECT vec_id AS item_id, label AS class, '*' AS superclass FROM embeddings
  WHERE label IN (SELECT class FROM (SELECT class, row_number() OVER (ORDER BY {S.md5key(7, '@class')}, class) AS rk,
  count(*) OVER () AS cc FROM (SELECT DISTINCT label AS class FROM embeddings)) WHERE rk <= floor(cc * 0.8)))"""


@register("sample_train_batch", f"""WITH {_scoped_sql(_TRAIN_VEC, 32, 20)}
SELECT step, draw, 0 AS pair_no, i0 AS a, i1 AS b, 1 AS label FROM res
UNION ALL SELECT step, draw, 1 AS pair_no, i2 AS a, i3 AS b, 0 AS label FROM res""")
def q_sample_train_batch(spark, sf):
    items = fx.items_vec(spark, sf)
    train = C.restrict(items, C.split_classes(items, 0.8, 7), "train")
    return D.sample_train_batch(train, 32, 20, SEED)


# ---------------------------------------------------------------- D4-D7
@register("sample_episodes", f"""WITH {_pairs_sql()}
SELECT episode::BIGINT AS episode, slot::INTEGER AS slot, way::INTEGER AS way, shot::INTEGER AS shot, class,
  member_idx::BIGINT AS member_idx, item_id FROM ep""")
def q_sample_episodes(spark, sf):
    ep, _ = _pairs(spark, sf)
    return ep


def _episodes_nr_sql(E=50, way=5, shot=5, seed=SEED) -> str:
    cw, lw = S.distinct_chain("e0", "C", way, seed, ("@episode", "c"), prefix="cw", out="c")
    cs, ls = S.distinct_chain("w1", "n", shot, seed, ("@episode", "@way", "s"), prefix="cs", out="s")
    ways = " UNION ALL ".join(f"SELECT episode, {j} AS way, c{j} AS class_idx FROM {lw}" for j in range(way))
    shots = " UNION ALL ".join(f"SELECT episode, way, class, {j} AS shot, s{j} AS member_idx FROM {ls}"
                               for j in range(shot))
    return f"""{S.ITEMS_TEXT}, {MI},
el AS (SELECT * FROM mi WHERE n >= {shot}),
lab AS (SELECT class, n, row_number() OVER (ORDER BY class) - 1 AS class_idx FROM (SELECT DISTINCT class, n FROM el)),
e0 AS (SELECT e.e AS episode, (SELECT count(*) FROM lab) AS C FROM range({E}) e(e)),
{cw},
w0 AS ({ways}),
w1 AS (SELECT w0.episode, w0.way, lab.class, lab.n FROM w0 JOIN lab USING (class_idx)),
{cs},
s AS ({shots})"""


@register("sample_episodes_no_replacement", f"""WITH {_episodes_nr_sql()}
SELECT s.episode::BIGINT AS episode, (s.way * 5 + s.shot)::INTEGER AS slot, s.way::INTEGER AS way,
  s.shot::INTEGER AS shot, s.class, s.member_idx::BIGINT AS member_idx, el.item_id
FROM s JOIN el USING (class, member_idx)""")
def q_sample_episodes_no_replacement(spark, sf):
    return D.sample_episodes(fx.items_text(spark, sf), 50, 5, 5, SEED, replace=False)


@register("episode_pairs", f"""WITH {_pairs_sql()}
SELECT episode::BIGINT AS episode, pair_no::INTEGER AS pair_no, a, b, label FROM pr""")
def q_episode_pairs(spark, sf):
    _, pr = _pairs(spark, sf)
    return pr


@register("episode_remainder", f"""WITH {_pairs_sql(E=20)},
ways AS (SELECT DISTINCT episode, way, class FROM ep)
SELECT w.episode::BIGINT AS episode, w.way::INTEGER AS way, w.class, mi.member_idx::BIGINT AS member_idx, mi.item_id
FROM ways w JOIN mi USING (class)
WHERE NOT EXISTS (SELECT 1 FROM ep x WHERE x.episode = w.episode AND x.way = w.way AND x.member_idx = mi.member_idx)""")
def q_episode_remainder(spark, sf):
    items = fx.items_vec(spark, sf)
    ep, _ = _pairs(spark, sf, E=20, items=items)
    return D.episode_remainder(ep, items, SEED)


@register("episode_query_pairs", f"""WITH {_pairs_sql()},
ways AS (SELECT DISTINCT episode, way, class FROM ep),
rem AS (SELECT w.episode, w.way, mi.member_idx, mi.item_id, mi.class FROM ways w JOIN mi USING (class)
        WHERE NOT EXISTS (SELECT 1 FROM ep x WHERE x.episode = w.episode AND x.way = w.way
                          AND x.member_idx = mi.member_idx)),
rn AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY way, member_idx) - 1 AS g,
       count(*) OVER (PARTITION BY episode) AS R FROM rem),
pick AS (SELECT episode, item_id AS query, class AS qclass FROM rn WHERE g = {S.idx('R', SEED, '@episode', 'q')})
SELECT ep.episode::BIGINT AS episode, ep.slot::INTEGER AS slot, ep.item_id AS support, pick.query,
  CASE WHEN ep.class = pick.qclass THEN 1 ELSE 0 END AS label FROM ep JOIN pick USING (episode)""")
def q_episode_query_pairs(spark, sf):
    items = fx.items_vec(spark, sf)
    ep, _ = _pairs(spark, sf, items=items)
    return D.episode_query_pairs(ep, items, SEED)


# ---------------------------------------------------------------- D8-D10
def _d8_sql(n=20, tasks=10, seed=SEED) -> str:
    ch, last = S.distinct_chain("t1", "n", 2, seed, ("@superclass", "@task"))
    nneg = "cs" if n == -1 else f"least({n}, cs)"
    gch, glast = S.distinct_chain("t2", "cs - 1", n - 1, seed, ("@superclass", "@task", "neg"), prefix="ngc", out="g")
    glist = ", ".join(f"g{j}" for j in range(n - 1))
    return f"""{S.ITEMS_TEXT}, {MI},
el AS (SELECT * FROM mi WHERE n >= 2),
cl AS (SELECT *, row_number() OVER (PARTITION BY superclass ORDER BY class) - 1 AS cidx,
       count(*) OVER (PARTITION BY superclass) AS cs FROM (SELECT DISTINCT superclass, class, n FROM el)),
t0 AS (SELECT s.superclass, s.cs, t.t AS task FROM (SELECT DISTINCT superclass, cs FROM cl) s, range({tasks}) t(t)),
t1 AS (SELECT t0.superclass, t0.task, t0.cs, cl.class, cl.n, cl.cidx FROM t0 JOIN cl ON cl.superclass = t0.superclass
       AND cl.cidx = {S.idx('t0.cs', seed, '@t0.superclass', '@t0.task', 'c')}),
{ch},
t2 AS (SELECT x.superclass, x.task, x.class, x.cidx, x.cs, {nneg} - 1 AS nneg, a.item_id AS query,
       b.item_id AS positive
       FROM {last} x JOIN el a ON a.class = x.class AND a.member_idx = x.x0
       JOIN el b ON b.class = x.class AND b.member_idx = x.x1),
{gch},
ng1 AS (SELECT superclass, task, query, nneg, cidx, unnest([{glist}]) AS o,
        generate_subscripts([{glist}], 1) AS pair_no FROM {glast}),
ng0 AS (SELECT ng1.superclass, ng1.task, ng1.query, ng1.nneg, ng1.pair_no, cl.class, cl.n FROM ng1 JOIN cl
        ON cl.superclass = ng1.superclass AND cl.cidx = CASE WHEN ng1.o >= ng1.cidx THEN ng1.o + 1 ELSE ng1.o END
        WHERE ng1.pair_no <= ng1.nneg),
ng AS (SELECT ng0.superclass, ng0.task, ng0.pair_no, ng0.query, el.item_id AS support FROM ng0 JOIN el
       ON el.class = ng0.class AND el.member_idx = {S.idx('ng0.n', seed, '@ng0.superclass', '@ng0.task', '@ng0.class', 'm')}
       WHERE ng0.pair_no <= ng0.nneg)"""


@register("one_shot_tasks_scoped", f"""WITH {_d8_sql()}
SELECT superclass, task, 0::INTEGER AS pair_no, query, positive AS support, 1 AS label FROM t2
UNION ALL SELECT superclass, task, pair_no::INTEGER AS pair_no, query, support, 0 AS label FROM ng""")
def q_one_shot_tasks_scoped(spark, sf):
    return D.one_shot_tasks_scoped(fx.items_text(spark, sf), 20, 10, SEED)


_D8_ALL = _d8_sql(n=2, tasks=10).replace("least(2, cs)", "cs").split("ng1 AS (", 1)[0]


@register("one_shot_tasks_all_classes", f"""WITH {_D8_ALL}
ng0 AS (SELECT t2.superclass, t2.task, t2.query, cl.class, cl.n,
        row_number() OVER (PARTITION BY t2.superclass, t2.task ORDER BY
            {S.md5key(SEED, '@t2.superclass', '@t2.task', '@cl.class')}, cl.class) AS pair_no
        FROM t2 JOIN cl ON cl.superclass = t2.superclass AND cl.cidx <> t2.cidx),
ng AS (SELECT ng0.superclass, ng0.task, ng0.pair_no, ng0.query, el.item_id AS support FROM ng0 JOIN el
       ON el.class = ng0.class AND el.member_idx = {S.idx('ng0.n', SEED, '@ng0.superclass', '@ng0.task', '@ng0.class', 'm')})
SELECT superclass, task, 0::INTEGER AS pair_no, query, positive AS support, 1 AS label FROM t2
UNION ALL SELECT superclass, task, pair_no::INTEGER AS pair_no, query, support, 0 AS label FROM ng""")
def q_one_shot_tasks_all_classes(spark, sf):
    """D8 with every class of the superclass in each task (n = -1)."""
    return D.one_shot_tasks_scoped(fx.items_text(spark, sf), -1, 10, SEED)


def _d9_sql(n=5, tasks=100, seed=SEED) -> str:
    ch, last = S.distinct_chain("t1", "n", 2, seed, ("@task",))
    nneg = "C - 1" if n == -1 else str(n - 1)
    return f"""{S.ITEMS_VEC}, {MI},
el AS (SELECT * FROM mi WHERE n >= 2),
lab AS (SELECT class, n, row_number() OVER (ORDER BY class) - 1 AS class_idx, count(*) OVER () AS C
        FROM (SELECT DISTINCT class, n FROM el)),
t1 AS (SELECT t.t AS task, lab.class, lab.class_idx, lab.n, lab.C FROM range({tasks}) t(t), lab
       WHERE lab.class_idx = {S.idx('lab.C', seed, '@t.t', 'c')}),
{ch},
t2 AS (SELECT x.task, x.class_idx, x.C, a.item_id AS query, b.item_id AS positive FROM {last} x
       JOIN el a ON a.class = x.class AND a.member_idx = x.x0 JOIN el b ON b.class = x.class AND b.member_idx = x.x1),
ng0 AS (SELECT t2.task, t2.query, j.j AS pair_no, t2.class_idx, t2.C,
        {S.idx('t2.C - 1', seed, '@t2.task', '@j.j', 'o')} AS o FROM t2, range(1, {nneg} + 1) j(j)),
ng1 AS (SELECT ng0.*, CASE WHEN o >= class_idx THEN o + 1 ELSE o END AS oidx FROM ng0),
ng AS (SELECT ng1.task, ng1.pair_no, ng1.query, el.item_id AS support FROM ng1 JOIN lab ON lab.class_idx = ng1.oidx
       JOIN el ON el.class = lab.class AND el.member_idx = {S.idx('lab.n', seed, '@ng1.task', '@ng1.pair_no', 'm')}),
tasks AS (SELECT task, 0 AS pair_no, query, positive AS support, 1 AS label FROM t2
          UNION ALL SELECT task, pair_no::INTEGER, query, support, 0 AS label FROM ng)"""


@register("one_shot_tasks", f"""WITH {_d9_sql()} SELECT task, pair_no::INTEGER AS pair_no, query, support, label FROM tasks""")
def q_one_shot_tasks(spark, sf):
    return D.one_shot_tasks(fx.items_vec(spark, sf), 5, 100, SEED)


@register("alternating_labels", f"""WITH {_d9_sql(n=20, tasks=50)}
SELECT task, pair_no::INTEGER AS pair_no, CASE WHEN pair_no % 2 = 0 THEN 1 ELSE 0 END AS train_label,
  CASE WHEN pair_no = 0 THEN 1 ELSE 0 END AS one_shot_label FROM tasks""")
def q_alternating_labels(spark, sf):
    t = D.one_shot_tasks(fx.items_vec(spark, sf), 20, 50, SEED)
    return t.select("task", "pair_no", D.alternating_labels(F.col("pair_no"), False).alias("train_label"),
                    D.alternating_labels(F.col("pair_no"), True).alias("one_shot_label"))


# ---------------------------------------------------------------- D12
SWEEP = [100, 200, 300]                      # episodes of the reference's three runs
_SWEEP_SQL = (_pairs_sql(E=0)
              .replace(S.ITEMS_VEC, f"""{S.ITEMS_TEXT},
th AS (SELECT unnest({SWEEP}) AS t UNION
       SELECT whole FROM (SELECT ceil(count(*) / 25.0)::INTEGER AS whole FROM items) WHERE whole > {max(SWEEP)})""")
              .replace("range(0) e(e)", "(SELECT unnest(range((SELECT max(t) FROM th)))) e(e)"))


@register("scale_sweep", f"""WITH {_SWEEP_SQL},
cnt AS (SELECT th.t AS episodes, count(*) AS pairs, sum(label) AS positives FROM pr, th WHERE pr.episode < th.t
        GROUP BY th.t),
used AS (SELECT item_id, min(episode) AS first_ep FROM (SELECT episode, a AS item_id FROM pr UNION ALL
         SELECT episode, b FROM pr) GROUP BY item_id),
tok AS (SELECT DISTINCT d.doc_id AS item_id, unnest(string_split(trim(d.text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), ' ')) AS token
        FROM documents d WHERE d.doc_id IN (SELECT item_id FROM used)),
tf AS (SELECT token, min(first_ep) AS first_ep FROM tok JOIN used USING (item_id) GROUP BY token),
voc AS (SELECT th.t AS episodes, count(*) AS vocab_size FROM tf, th WHERE tf.first_ep < th.t GROUP BY th.t)
SELECT cnt.episodes::INTEGER AS episodes, cnt.pairs::BIGINT AS pairs, cnt.positives::BIGINT AS positives,
  coalesce(voc.vocab_size, 0)::BIGINT AS vocab_size FROM cnt LEFT JOIN voc USING (episodes)""")
def q_scale_sweep(spark, sf):
    """The sizes of the reference, and for a table that they leave mostly undrawn one with as many draws as items."""
    items = fx.items_text(spark, sf)
    return D.scale_sweep(items, tokenize(F.col("text")), D.sweep_sizes(SWEEP, 25, items.count()), 300, 5, 5, SEED)
