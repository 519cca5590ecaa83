"""2x3 affine matrices and nearest-neighbour resampling of row-major array images.

A matrix is ``array<double>`` ``[a, b, c, d, e, f]``: output pixel (i, j) reads the input at
``(a*i + b*j + c, d*i + e*j + f)``, rounded to the nearest pixel and clamped to the edge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kshot.functions.vectors import bind_once


def _centred(m00: Column, m01: Column, m10: Column, m11: Column, rows: int, cols: int) -> Column:
    ox, oy = rows / 2 + 0.5, cols / 2 + 0.5
    return F.array(m00, m01, F.lit(ox) - m00 * ox - m01 * oy,
                   m10, m11, F.lit(oy) - m10 * ox - m11 * oy)


def affine_rotation(theta_deg: Column, rows: int, cols: int) -> Column:
    """Rotation by ``theta`` degrees about the image centre."""
    t = F.radians(theta_deg)
    return _centred(F.cos(t), -F.sin(t), F.sin(t), F.cos(t), rows, cols)


def affine_shear(shear_deg: Column, rows: int, cols: int) -> Column:
    """Shear [1, -sin; 0, cos] about the centre."""
    s = F.radians(shear_deg)
    return _centred(F.lit(1.0), -F.sin(s), F.lit(0.0), F.cos(s), rows, cols)


def affine_shift(tx: Column, ty: Column) -> Column:
    """Translation, no centring."""
    return F.array(F.lit(1.0), F.lit(0.0), tx.cast("double"), F.lit(0.0), F.lit(1.0), ty.cast("double"))


def affine_zoom(zx: Column, zy: Column, rows: int, cols: int) -> Column:
    """Independent axis zoom about the centre."""
    return _centred(zx.cast("double"), F.lit(0.0), F.lit(0.0), zy.cast("double"), rows, cols)


def apply_affine(image: Column, m: Column, rows: int, cols: int) -> Column:
    """Nearest-neighbour (round half up) resampling, coordinates clamped to the edge.

    Coordinates are rounded to 9 decimals first so an exact .5 resolves identically everywhere.
    """
    return apply_affine_chain(image, F.array(m), rows, cols)


def _map(acc: Column, m: Column, rows: int, cols: int) -> Column:
    x = F.floor(F.round(m[0] * acc["i"] + m[1] * acc["j"] + m[2], 9) + 0.5)
    y = F.floor(F.round(m[3] * acc["i"] + m[4] * acc["j"] + m[5], 9) + 0.5)
    return F.struct(F.least(F.greatest(x, F.lit(0)), F.lit(rows - 1)).cast("int").alias("i"),
                    F.least(F.greatest(y, F.lit(0)), F.lit(cols - 1)).cast("int").alias("j"))


def apply_affine_chain(image: Column, mats_last_first: Column, rows: int, cols: int) -> Column:
    """Several nearest-neighbour resamplings in one pass.

    Resampling with maps c1 then c2 gives ``out[p] = in[c1(c2(p))]``, so each output pixel folds its
    coordinate through the matrices from the last applied to the first and reads the source once.
    ``mats_last_first`` is ``array<array<double>>`` (empty = identity).
    """
    def body(b):
        def px(k):
            start = F.struct((k / cols).cast("int").alias("i"), (k % cols).cast("int").alias("j"))
            src = F.aggregate(b["m"], start, lambda acc, m: _map(acc, m, rows, cols))
            return F.element_at(b["v"], src["i"] * cols + src["j"] + 1)
        return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), px)
    return bind_once(F.struct(image.alias("v"), mats_last_first.alias("m")), body)


SHEAR_DEG = 0.3 * 180 / math.pi
