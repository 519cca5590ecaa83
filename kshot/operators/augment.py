"""Pair augmentation of array images (J1, J7): keyed random plan, then chained affine resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kshot.functions.affine import (SHEAR_DEG, affine_rotation, affine_shear, affine_shift, affine_zoom,
                                    apply_affine_chain)
from kshot.functions.draw import keyed_uniform

OPS = ("rotation", "shear", "shift", "zoom")


@dataclass(frozen=True)
class Ranges:
    rotation: tuple[float, float] = (-15.0, 15.0)
    shear: tuple[float, float] = (-SHEAR_DEG, SHEAR_DEG)
    shift: tuple[float, float] = (1.0, 1.0)
    zoom: tuple[float, float] = (0.8, 2.0)
    probability: float = 0.5


def _u(seed, key: Column, side: Column, *tags) -> Column:
    return keyed_uniform(seed, key, side, *tags)


def _params(seed, key: Column, side: Column, rg: Ranges) -> dict[str, Column]:
    def uni(lo, hi, *tags):
        return F.lit(lo) + F.lit(hi - lo) * _u(seed, key, side, *tags)
    return {
        "rotation_sel": _u(seed, key, side, "rotation", "sel") < rg.probability,
        "shear_sel": _u(seed, key, side, "shear", "sel") < rg.probability,
        "shift_sel": _u(seed, key, side, "shift", "sel") < rg.probability,
        "zoom_sel": _u(seed, key, side, "zoom", "sel") < rg.probability,
        "theta": uni(rg.rotation[0], rg.rotation[1], "rotation", "a"),
        "shear": uni(rg.shear[0], rg.shear[1], "shear", "a"),
        "tx": uni(-rg.shift[0], rg.shift[0], "shift", "x"),
        "ty": uni(-rg.shift[1], rg.shift[1], "shift", "y"),
        "zx": uni(rg.zoom[0], rg.zoom[1], "zoom", "x"),
        "zy": uni(rg.zoom[0], rg.zoom[1], "zoom", "y"),
    }


def augmentation_plan(pairs: DataFrame, key: str, seed, rg: Ranges = Ranges()) -> DataFrame:
    """``(key, side, op, p1, p2)`` for every selected op of every pair side (each op is chosen with
    probability ``rg.probability``, parameters uniform in their ranges)."""
    sides = pairs.select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    p = _params(seed, F.col(key), F.col("side"), rg)
    ops = F.array(
        F.struct(F.lit("rotation").alias("op"), p["rotation_sel"].alias("sel"), p["theta"].alias("p1"),
                 F.lit(None).cast("double").alias("p2")),
        F.struct(F.lit("shear").alias("op"), p["shear_sel"].alias("sel"), p["shear"].alias("p1"),
                 F.lit(None).cast("double").alias("p2")),
        F.struct(F.lit("shift").alias("op"), p["shift_sel"].alias("sel"), p["tx"].alias("p1"), p["ty"].alias("p2")),
        F.struct(F.lit("zoom").alias("op"), p["zoom_sel"].alias("sel"), p["zx"].alias("p1"), p["zy"].alias("p2")))
    return (sides.select(key, "side", F.explode(ops).alias("o")).where("o.sel")
            .select(key, "side", "o.op", "o.p1", "o.p2"))


def augment_image(image: Column, key: Column, side: Column, seed, rows: int, cols: int,
                  rg: Ranges = Ranges()) -> Column:
    """J7 for one image: selected ops applied in the order rotation, shear, shift, zoom, resampling
    after each (the expression stays JVM-side, whole-stage codegen)."""
    return apply_affine_chain(image, selected_matrices(key, side, seed, rows, cols, rg), rows, cols)


def selected_matrices(key: Column, side: Column, seed, rows: int, cols: int, rg: Ranges = Ranges()) -> Column:
    """The selected ops' matrices, last applied first (zoom, shift, shear, rotation)."""
    p = _params(seed, key, side, rg)
    steps = [("zoom_sel", affine_zoom(p["zx"], p["zy"], rows, cols)),
             ("shift_sel", affine_shift(p["tx"], p["ty"])),
             ("shear_sel", affine_shear(p["shear"], rows, cols)),
             ("rotation_sel", affine_rotation(p["theta"], rows, cols))]
    picked = F.array(*[F.when(p[sel], m) for sel, m in steps])
    return F.filter(picked, lambda m: m.isNotNull())


def augment_pairs(pairs: DataFrame, key: str, img_a: str, img_b: str, seed, rows: int, cols: int,
                  rg: Ranges = Ranges()) -> DataFrame:
    """Both sides of every pair augmented independently (side 0 = a, side 1 = b)."""
    k = F.col(key)
    # matrices first, as columns, so the per-pixel lambda only reads them
    with_m = pairs.withColumn("_ma", selected_matrices(k, F.lit(0), seed, rows, cols, rg)).withColumn(
        "_mb", selected_matrices(k, F.lit(1), seed, rows, cols, rg))
    return (with_m.withColumn(img_a, apply_affine_chain(F.col(img_a), F.col("_ma"), rows, cols))
            .withColumn(img_b, apply_affine_chain(F.col(img_b), F.col("_mb"), rows, cols))
            .drop("_ma", "_mb"))
