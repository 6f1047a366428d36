"""Resampling of packed images (width, height, row-major array of doubles) by native array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

METHODS = ("nearest", "bilinear", "bicubic", "lanczos")
LOBES = 3
#: New pixels that one task works out.
SAMPLES = 50_000


def _at(data: Column, w: Column, h: Column, x: Column, y: Column) -> Column:
    cx = F.greatest(F.lit(0), F.least(w - 1, x)).cast("int")
    cy = F.greatest(F.lit(0), F.least(h - 1, y)).cast("int")
    return F.element_at(data, (cy * w + cx + 1).cast("int"))


def cubic_weight(t: Column) -> Column:
    """Piecewise cubic with a = -0.5."""
    a, u = -0.5, F.abs(t)
    return F.when(u <= 1, (a + 2) * u * u * u - (a + 3) * u * u + 1).when(u < 2, a * u * u * u - 5 * a * u * u + 8 * a * u - 4 * a).otherwise(0.0)


def sinc(x: Column) -> Column:
    p = x * math.pi
    return F.when(x == 0, 1.0).otherwise(F.sin(p) / p)


def lanczos_weight(x: Column, lobes: int = LOBES) -> Column:
    return F.when(x == 0, 1.0).when(F.abs(x) >= lobes, 0.0).otherwise(sinc(x) * sinc(x / lobes))


def _prepared(x: Column, y: Column, method: str) -> Column:
    """Place, first tap and weights of each direction, worked out once for a sample."""
    if method == "nearest":
        return F.struct(F.floor(x + 0.5).alias("fx"), F.floor(y + 0.5).alias("fy"), F.array(F.lit(1.0)).alias("wx"), F.array(F.lit(1.0)).alias("wy"))
    fx, fy = F.floor(x), F.floor(y)
    if method == "bilinear":
        weights = lambda t, f: F.array(1 - (t - f), t - f)
    else:
        weight = cubic_weight if method == "bicubic" else lambda t: lanczos_weight(t)
        weights = lambda t, f: F.transform(F.array(*(t - (f + k) for k in _reach(method))), weight)
    return F.struct(fx.alias("fx"), fy.alias("fy"), weights(x, fx).alias("wx"), weights(y, fy).alias("wy"))


def _reach(method: str) -> range:
    return {"nearest": range(1), "bilinear": range(2), "bicubic": range(-1, 3), "lanczos": range(1 - LOBES, LOBES + 1)}[method]


def _weighted(data: Column, w: Column, h: Column, s: Column, method: str) -> Column:
    total = mass = F.lit(0.0)
    for b, j in enumerate(_reach(method)):
        line = F.lit(0.0)
        for a, i in enumerate(_reach(method)):
            line = line + _at(data, w, h, s["fx"] + i, s["fy"] + j) * s["wx"][a]
        total = total + line * s["wy"][b]
    if method != "lanczos":
        return total
    sums = [sum((s[c][k] for k in range(1, 2 * LOBES)), s[c][0]) for c in ("wx", "wy")]
    mass = sums[0] * sums[1]
    return F.when(mass == 0, 0.0).otherwise(total / mass)


def sample(data: Column, w: Column, h: Column, x: Column, y: Column, method: str = "bilinear") -> Column:
    """Value at a place between pixels; beyond the edge the edge pixel counts; 0 for an empty image."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    value = F.transform(F.array(_prepared(x, y, method)), lambda s: _weighted(data, w, h, s, method))[0]
    return F.when((w <= 0) | (h <= 0) | (F.size(data) == 0), 0.0).otherwise(value)


def resample(images: DataFrame, width: int, height: int, method: str = "bilinear", out: str = "resampled") -> DataFrame:
    """images: w, h, data array<double>. Adds the array of the new size; an empty one if any size is 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    w, h, data = F.col("w"), F.col("h"), F.col("data")
    empty = F.array().cast("array<double>")
    if width <= 0 or height <= 0:
        return images.withColumn(out, empty)
    place = lambda k: _prepared((k % width + 0.5) * (w / F.lit(float(width))) - 0.5, (F.floor(k / width) + 0.5) * (h / F.lit(float(height))) - 0.5, method)
    places = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), place)
    images = spread(images, max(1, SAMPLES // (width * height)))
    values = F.when((w <= 0) | (h <= 0), empty).otherwise(F.transform(places, lambda s: _weighted(data, w, h, s, method)))
    # unfolded, so that what is asked of the values is not worked out below the dealing, in one task
    return images.withColumn(out, F.explode(F.array(values)))
