"""Pair scorers learned with Spark ML over fixed vectors (H1-H6).

With frozen item vectors, a sigmoid over w.|a-b| + b is exactly a logistic regression on the
absolute-difference features, and the dense heads are a multilayer perceptron; both train with
Spark ML's distributed optimisers (tree aggregation of gradients), never on the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.functions.draw import keyed_hash, keyed_uniform
from kshot.functions.vectors import abs_diff, concat_features
from kshot.operators.scoring import bce

# The search space of the original hyper-parameter search (13 dimensions).
CONTINUOUS = [("learning_rate", 10e-6, 10e-4), ("momentum", 0.0, 1.0), ("momentum_slope", 0.001, 0.1)]
MULTIPLIERS = (0.01, 0.1, 1, 10)
L2 = (0, 0.0001, 0.001, 0.01, 0.1)
DISCRETE = ([(f"{n}_multiplier", MULTIPLIERS) for n in ("Conv1", "Conv2", "Conv3", "Conv4", "Dense1")]
            + [(f"l2_penalization_{n}", L2) for n in ("Conv1", "Conv2", "Conv3", "Conv4", "Dense1")])


def features(pairs: DataFrame, kind: str = "absdiff", va: str = "va", vb: str = "vb") -> DataFrame:
    f = abs_diff(F.col(va), F.col(vb)) if kind == "absdiff" else concat_features(F.col(va), F.col(vb))
    return (pairs.withColumn("_dim_a", F.col(va)).withColumn("_dim_c", F.concat(F.col(va), F.col(vb)))
            .withColumn("features", array_to_vector(f)).withColumn("label", F.col("label").cast("double")))


def _fit(estimator, f: DataFrame):
    """Iterative optimisers scan the training frame once per iteration: keep it cached for the fit
    (a lost cached block is recomputed from lineage)."""
    f = f.select("features", "label").persist()
    try:
        return estimator.fit(f)
    finally:
        f.unpersist()


def fit_logistic_absdiff(pairs: DataFrame, reg: float = 0.0, max_iter: int = 50):
    """H1: sigmoid(w.|a-b| + b)."""
    return _fit(LogisticRegression(regParam=reg, maxIter=max_iter), features(pairs, "absdiff"))


def fit_logistic_concat(pairs: DataFrame, reg: float = 0.0, max_iter: int = 50):
    """H2: sigmoid(w.[a;b] + b)."""
    return _fit(LogisticRegression(regParam=reg, maxIter=max_iter), features(pairs, "concat"))


def fit_mlp(pairs: DataFrame, kind: str = "absdiff", hidden: tuple[int, ...] = (32,), max_iter: int = 50, seed=7):
    """H3: sigmoid hidden layers (32 or 32-16) on |a-b| or [a;b]; two softmax outputs."""
    f = features(pairs, kind)
    dim = f.select(F.size(F.col(pairs_dim_col(kind)))).first()[0]
    mlp = MultilayerPerceptronClassifier(layers=[dim, *hidden, 2], maxIter=max_iter, seed=seed)
    return _fit(mlp, f)


def pairs_dim_col(kind: str) -> str:
    return "_dim_a" if kind == "absdiff" else "_dim_c"


def evaluate_model(model, pairs: DataFrame, kind: str = "absdiff") -> DataFrame:
    """H4: mean BCE and accuracy (threshold 0.5) of a fitted head on unseen pairs."""
    scored = model.transform(features(pairs, kind)).withColumn(
        "p", vector_to_array(F.col("probability"))[1])
    return scored.agg(F.avg(bce(F.col("p"), F.col("label"))).alias("loss"),
                      F.avg(((F.col("p") > 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy"))


def sample_search_space(spark, n: int, seed) -> DataFrame:
    """H5: ``n`` candidates, continuous dimensions uniform, discrete ones uniform over their sets."""
    c = spark.range(n).select(F.col("id").alias("candidate"))
    cols = [(F.lit(lo) + F.lit(hi - lo) * keyed_uniform(seed, F.col("candidate"), name)).alias(name)
            for name, lo, hi in CONTINUOUS]
    for name, choices in DISCRETE:
        arr = F.array(*[F.lit(float(x)) for x in choices])
        cols.append(F.element_at(arr, (keyed_hash(seed, F.col("candidate"), name) % len(choices) + 1).cast("int"))
                    .alias(name))
    return c.select("candidate", *cols)


def search(candidates: list[dict], fit, objective, threads: int = 4) -> list[dict]:
    """H6: fit and score every candidate (each a Spark job; a few run concurrently from a small
    driver thread pool) and return ``[{**candidate, 'objective': x}]``; the best has the least objective."""
    def one(c):
        return {**c, "objective": float(objective(fit(c)))}
    with ThreadPoolExecutor(max_workers=threads) as ex:
        return list(ex.map(one, candidates))
