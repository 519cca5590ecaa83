"""Queries: training-log analytics (I1-I6) and pair augmentation of array images."""

from __future__ import annotations

from pyspark.sql import functions as F

from kshot.functions import affine as A
from kshot.functions.draw import keyed_uniform
from kshot.operators import augment as AU
from kshot.operators import runlog as RL
from kshot.plans import fixtures as fx
from kshot.plans import sqlkit as S
from kshot.plans.q_vectors import VP, vec_pairs
from kshot.plans.registry import register

SEED = 42
RLOG = """rl AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration,
  value AS loss, (event_id % 3) / 2.0 AS accuracy, (event_id % 101) / 100.0 AS validation FROM events)"""


def _r(c, d=6):
    return F.round(c, d) + F.lit(0.0)


def dl(x: float) -> str:
    return f"('{x!r}'::DOUBLE)"


# ---------------------------------------------------------------- I1-I6
_STEPS = 40  # ceil((0.9 - 0.5) / 0.01) after rounding to 9 decimals


@register("schedule", f"""WITH {RLOG}
SELECT run, iteration, (round(0.001 * pow(0.99, floor(iteration / 500)), 12) + 0.0)::DOUBLE AS lr,
  (round({dl(0.5)} + {dl(0.01)} * least(iteration, {_STEPS}), 9) + 0.0)::DOUBLE AS momentum FROM rl""")
def q_schedule(spark, sf):
    s = RL.schedule(fx.run_log(spark, sf), 0.001, 0.01, 0.9)
    return s.select("run", "iteration", _r(F.col("lr"), 12).alias("lr"), _r(F.col("momentum"), 9).alias("momentum"))


@register("log_windows", f"""WITH {RLOG},
b AS (SELECT run, (iteration - 1) // 10 AS block, count(*) AS n, avg(loss) AS loss, avg(accuracy) AS accuracy,
      arg_max(validation, iteration) AS validation FROM rl GROUP BY run, (iteration - 1) // 10)
SELECT run, block::BIGINT AS block, {S.r('loss')} AS loss, {S.r('accuracy')} AS accuracy,
  {S.r('validation')} AS validation FROM b WHERE n = 10""")
def q_log_windows(spark, sf):
    w = RL.log_windows(fx.run_log(spark, sf), 10)
    return w.select("run", "block", *[_r(F.col(c)).alias(c) for c in ("loss", "accuracy", "validation")])


_IMP = f"""{RLOG},
pv AS (SELECT *, max(validation) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING) AS prev FROM rl),
im AS (SELECT *, validation > coalesce(prev, 0.0) AS improved FROM pv)"""


@register("best_checkpoint", f"""WITH {_IMP}
SELECT run, iteration, {S.r('validation')} AS validation FROM im WHERE improved""")
def q_best_checkpoint(spark, sf):
    b = RL.best_checkpoint(fx.run_log(spark, sf))
    return b.select("run", "iteration", _r(F.col("validation")).alias("validation"))


@register("early_stop", f"""WITH {_IMP},
la AS (SELECT *, max(CASE WHEN improved THEN iteration ELSE 1 END) OVER (PARTITION BY run ORDER BY iteration
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM im)
SELECT run, min(iteration) AS stop_iteration FROM la WHERE iteration - last_imp > 20 GROUP BY run""")
def q_early_stop(spark, sf):
    return RL.early_stop(fx.run_log(spark, sf), 20)


@register("collapse_stop", f"""WITH {RLOG}
SELECT run, min(iteration) AS stop_iteration FROM rl WHERE iteration % 10 = 0
  AND ((validation = 1.0 AND accuracy = 0.5) OR accuracy = 0.0) GROUP BY run""")
def q_collapse_stop(spark, sf):
    return RL.collapse_stop(fx.run_log(spark, sf), 10)


@register("best_run", f"""WITH {RLOG},
p AS (SELECT run, max(validation) AS best_validation, 1.0 - max(validation) AS objective FROM rl GROUP BY run)
SELECT first(run ORDER BY objective, run) AS run, {S.r('first(best_validation ORDER BY objective, run)')} AS best_validation,
  {S.r('first(objective ORDER BY objective, run)')} AS objective FROM p""")
def q_best_run(spark, sf):
    b = RL.best_run(fx.run_log(spark, sf))
    return b.select("run", _r(F.col("best_validation")).alias("best_validation"), _r(F.col("objective")).alias("objective"))


# ---------------------------------------------------------------- J1-J7
RG = AU.Ranges()
ROWS = COLS = 8
KEY_SQL = "concat_ws('|', class, round, pair_no)"


def _pairs_keyed(spark, sf):
    return vec_pairs(spark, sf).withColumn("key", F.concat_ws("|", "class", "round", "pair_no"))


def _uni_sql(lo: float, hi: float, *tags) -> str:
    return f"({dl(lo)} + {dl(hi - lo)} * {S.unif(SEED, '@key', '@side', *tags)})"


SIDES = f"""{VP},
sd AS (SELECT {KEY_SQL} AS key, s.side, CASE WHEN s.side = 0 THEN va ELSE vb END AS img
       FROM vp, (VALUES (0), (1)) s(side)),
pm AS (SELECT key, side, img,
  {S.unif(SEED, '@key', '@side', 'rotation', 'sel')} < 0.5 AS rot_sel,
  {S.unif(SEED, '@key', '@side', 'shear', 'sel')} < 0.5 AS shear_sel,
  {S.unif(SEED, '@key', '@side', 'shift', 'sel')} < 0.5 AS shift_sel,
  {S.unif(SEED, '@key', '@side', 'zoom', 'sel')} < 0.5 AS zoom_sel,
  {_uni_sql(RG.rotation[0], RG.rotation[1], 'rotation', 'a')} AS theta,
  {_uni_sql(RG.shear[0], RG.shear[1], 'shear', 'a')} AS shear,
  {_uni_sql(-RG.shift[0], RG.shift[0], 'shift', 'x')} AS tx,
  {_uni_sql(-RG.shift[1], RG.shift[1], 'shift', 'y')} AS ty,
  {_uni_sql(RG.zoom[0], RG.zoom[1], 'zoom', 'x')} AS zx,
  {_uni_sql(RG.zoom[0], RG.zoom[1], 'zoom', 'y')} AS zy FROM sd)"""


@register("augmentation_plan", f"""WITH {SIDES}
SELECT key, side, 'rotation' AS op, {S.r('theta', 9)} AS p1, NULL::DOUBLE AS p2 FROM pm WHERE rot_sel
UNION ALL SELECT key, side, 'shear', {S.r('shear', 9)}, NULL::DOUBLE FROM pm WHERE shear_sel
UNION ALL SELECT key, side, 'shift', {S.r('tx', 9)}, {S.r('ty', 9)} FROM pm WHERE shift_sel
UNION ALL SELECT key, side, 'zoom', {S.r('zx', 9)}, {S.r('zy', 9)} FROM pm WHERE zoom_sel""")
def q_augmentation_plan(spark, sf):
    p = AU.augmentation_plan(_pairs_keyed(spark, sf), "key", SEED, RG)
    return p.select("key", "side", "op", _r(F.col("p1"), 9).alias("p1"), _r(F.col("p2"), 9).alias("p2"))


OX, OY = ROWS / 2 + 0.5, COLS / 2 + 0.5


def _centred_sql(m00: str, m01: str, m10: str, m11: str) -> str:
    return (f"[{m00}, {m01}, {dl(OX)} - ({m00}) * {dl(OX)} - ({m01}) * {dl(OY)}, "
            f"{m10}, {m11}, {dl(OY)} - ({m10}) * {dl(OX)} - ({m11}) * {dl(OY)}]")


ROT_M = _centred_sql("cos(radians(theta))", "-sin(radians(theta))", "sin(radians(theta))", "cos(radians(theta))")
SHEAR_M = _centred_sql("1.0::DOUBLE", "-sin(radians(shear))", "0.0::DOUBLE", "cos(radians(shear))")
SHIFT_M = "[1.0::DOUBLE, 0.0::DOUBLE, tx, 0.0::DOUBLE, 1.0::DOUBLE, ty]"
ZOOM_M = _centred_sql("zx", "0.0::DOUBLE", "0.0::DOUBLE", "zy")


def _mat_q(op: str, sel: str, m_sql: str, m_col):
    return f"""WITH {SIDES} SELECT key, side, list_transform({m_sql}, lambda x: (round(x, 9) + 0.0)) AS matrix
FROM pm WHERE {sel}"""


def _mat_spark(spark, sf, sel: str, build):
    pr = _pairs_keyed(spark, sf)
    sides = pr.select("key", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    p = AU._params(SEED, F.col("key"), F.col("side"), RG)
    return sides.where(p[sel]).select("key", "side", F.transform(build(p), lambda x: _r(x, 9)).alias("matrix"))


@register("affine_rotation", _mat_q("rotation", "rot_sel", ROT_M, None))
def q_affine_rotation(spark, sf):
    return _mat_spark(spark, sf, "rotation_sel", lambda p: A.affine_rotation(p["theta"], ROWS, COLS))


@register("affine_shear", _mat_q("shear", "shear_sel", SHEAR_M, None))
def q_affine_shear(spark, sf):
    return _mat_spark(spark, sf, "shear_sel", lambda p: A.affine_shear(p["shear"], ROWS, COLS))


@register("affine_shift", _mat_q("shift", "shift_sel", SHIFT_M, None))
def q_affine_shift(spark, sf):
    return _mat_spark(spark, sf, "shift_sel", lambda p: A.affine_shift(p["tx"], p["ty"]))


@register("affine_zoom", _mat_q("zoom", "zoom_sel", ZOOM_M, None))
def q_affine_zoom(spark, sf):
    return _mat_spark(spark, sf, "zoom_sel", lambda p: A.affine_zoom(p["zx"], p["zy"], ROWS, COLS))


def apply_sql(img: str, m: str) -> str:
    def coord(a, b, c, hi):
        return (f"least(greatest(floor(round({m}[{a}] * (k // {COLS}) + {m}[{b}] * (k % {COLS}) + {m}[{c}], 9) + 0.5), 0),"
                f" {hi})::BIGINT")
    return (f"list_transform(range({ROWS * COLS}), lambda k: {img}[{coord(1, 2, 3, ROWS - 1)} * {COLS} + "
            f"{coord(4, 5, 6, COLS - 1)} + 1]::DOUBLE)")


@register("apply_affine", f"""WITH r AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: x::DOUBLE) AS img,
  ({dl(-15.0)} + {dl(30.0)} * {S.unif(SEED, '@vec_id', 'j6')}) AS theta FROM embeddings),
m AS (SELECT item_id, img, {ROT_M} AS mat FROM r)
SELECT item_id, {apply_sql('img', 'mat')} AS pixels FROM m""")
def q_apply_affine(spark, sf):
    im = fx.images(spark, sf)
    theta = F.lit(-15.0) + F.lit(30.0) * keyed_uniform(SEED, F.col("item_id"), "j6")
    im = im.withColumn("mat", A.affine_rotation(theta, ROWS, COLS))
    return im.select("item_id", A.apply_affine(F.col("pixels"), F.col("mat"), ROWS, COLS).alias("pixels"))


@register("augment_pairs", f"""WITH {SIDES},
a0 AS (SELECT key, side, list_transform(img, lambda x: x::DOUBLE) AS img, rot_sel, shear_sel, shift_sel, zoom_sel,
       {ROT_M} AS m1, {SHEAR_M} AS m2, {SHIFT_M} AS m3, {ZOOM_M} AS m4 FROM pm),
a1 AS (SELECT * REPLACE (CASE WHEN rot_sel THEN {apply_sql('img', 'm1')} ELSE img END AS img) FROM a0),
a2 AS (SELECT * REPLACE (CASE WHEN shear_sel THEN {apply_sql('img', 'm2')} ELSE img END AS img) FROM a1),
a3 AS (SELECT * REPLACE (CASE WHEN shift_sel THEN {apply_sql('img', 'm3')} ELSE img END AS img) FROM a2),
a4 AS (SELECT * REPLACE (CASE WHEN zoom_sel THEN {apply_sql('img', 'm4')} ELSE img END AS img) FROM a3)
SELECT key, max(CASE WHEN side = 0 THEN img END) AS img_a, max(CASE WHEN side = 1 THEN img END) AS img_b
FROM a4 GROUP BY key""")
def q_augment_pairs(spark, sf):
    pr = _pairs_keyed(spark, sf).select(
        "key", F.transform("va", lambda x: x.cast("double")).alias("img_a"),
        F.transform("vb", lambda x: x.cast("double")).alias("img_b"))
    return AU.augment_pairs(pr, "key", "img_a", "img_b", SEED, ROWS, COLS, RG)
