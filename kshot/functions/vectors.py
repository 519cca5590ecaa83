"""Vector math on ``array<float|double>`` columns, all as higher-order SQL functions (whole-stage codegen).

Sums run left to right inside ``aggregate`` so every engine adds in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + _d(x))


def abs_diff(a: Column, b: Column) -> Column:
    """Element-wise |a - b| as array<double>."""
    return F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y)))


def l1_distance(a: Column, b: Column) -> Column:
    return vsum(abs_diff(a, b))


def manhattan_similarity(a: Column, b: Column) -> Column:
    """exp(-sum |a - b|)."""
    return F.exp(-l1_distance(a, b))


def threshold_match(sim: Column, t: float = 0.5) -> Column:
    """1 when sim >= t."""
    return (sim >= F.lit(t)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def norm(a: Column) -> Column:
    return F.sqrt(vsum(F.transform(a, lambda x: _d(x) * _d(x))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot / (|a| |b|); null when a norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(vsum(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def relative_euclidean(a: Column, b: Column) -> tuple[Column, Column]:
    """E5: (|a-b| / (|a| + |b|), 1 - rint(dist)); rint rounds half to even like ``bround``."""
    den = norm(a) + norm(b)
    dist = F.when(den > 0, euclidean_distance(a, b) / den)
    return dist, (F.lit(1) - F.bround(dist, 0)).cast("int")


def concat_features(a: Column, b: Column) -> Column:
    """[a; b] as array<double>."""
    return F.concat(F.transform(a, _d), F.transform(b, _d))


def weighted_l1_probability(a: Column, b: Column, w, b0: float) -> Column:
    """sigmoid(w . |a - b| + b0); ``w`` is a Column or a list of floats."""
    w = w if isinstance(w, Column) else F.array(*[F.lit(float(x)) for x in w])
    z = vsum(F.zip_with(abs_diff(a, b), w, lambda x, y: x * _d(y))) + F.lit(float(b0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def vmean(v: Column) -> Column:
    return vsum(v) / F.size(v)


def bind_once(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Catalyst may inline a projected expression into a per-element lambda (re-evaluating it for every
    element); a one-element outer ``transform`` keeps it to one evaluation per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def standardize_vector(v: Column) -> Column:
    """X / std - mean (population std; the mean is not divided by std)."""
    def with_mean(b):
        mean = b["mean"]
        var = F.aggregate(b["v"], F.lit(0.0), lambda acc, x: acc + (_d(x) - mean) * (_d(x) - mean)) / F.size(b["v"])
        return bind_once(F.struct(b["v"].alias("v"), mean.alias("mean"), F.sqrt(var).alias("std")),
                         lambda c: F.transform(c["v"], lambda x: _d(x) / c["std"] - c["mean"]))
    return bind_once(F.struct(v.alias("v"), vmean(v).alias("mean")), with_mean)


def reshape_grid(v: Column, rows: int, cols: int) -> Column:
    """View a flat row-major vector as rows x cols."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(v, i * cols + 1, cols))


def round_vec(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(_d(x), digits))

