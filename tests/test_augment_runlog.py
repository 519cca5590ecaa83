from pyspark.sql import functions as F

from kshot.functions import affine as A
from kshot.operators import runlog as RL
from kshot.operators.learn import sample_search_space


def grid(spark):
    return spark.createDataFrame([([float(x) for x in range(9)],)], "img array<double>")


def test_identity_returns_image(spark):
    m = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])
    assert grid(spark).select(A.apply_affine(F.col("img"), m, 3, 3)).first()[0] == [float(x) for x in range(9)]


def test_shift_by_one_clamps_edge(spark):
    out = grid(spark).select(A.apply_affine(F.col("img"), A.affine_shift(F.lit(1.0), F.lit(0.0)), 3, 3)).first()[0]
    assert out == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 6.0, 7.0, 8.0]


def test_chain_equals_sequential_resampling(spark):
    m1 = A.affine_rotation(F.lit(12.0), 3, 3)
    m2 = A.affine_zoom(F.lit(1.3), F.lit(0.9), 3, 3)
    df = grid(spark)
    seq = df.select(A.apply_affine(F.col("img"), m1, 3, 3).alias("x")).select(A.apply_affine(F.col("x"), m2, 3, 3))
    one = df.select(A.apply_affine_chain(F.col("img"), F.array(m2, m1), 3, 3))
    assert seq.first()[0] == one.first()[0]


def test_plateau_log(spark):
    vals = [0.2, 0.1, 0.2, 0.15, 0.5] + [0.4] * 30
    log = spark.createDataFrame([(1, i + 1, 0.0, 1.0, v) for i, v in enumerate(vals)],
                                "run long, iteration long, loss double, accuracy double, validation double")
    assert [r.iteration for r in RL.best_checkpoint(log).orderBy("iteration").collect()] == [1, 5]
    assert RL.early_stop(log, 20).first().stop_iteration == 26
    assert RL.collapse_stop(log).count() == 0


def test_search_space_has_13_dimensions(spark):
    s = sample_search_space(spark, 20, 1)
    assert len(s.columns) == 14
    for r in s.collect():
        assert 10e-6 <= r.learning_rate <= 10e-4 and r.Conv1_multiplier in (0.01, 0.1, 1, 10)
