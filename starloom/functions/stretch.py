"""Intensity stretches of pixel values, as column expressions inside one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("linear", "log", "sqrt", "asinh", "sinh", "mtf", "histogram", "zscale", "percentile")


def js_round(x: Column, digits: int = 0) -> Column:
    """Half goes up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def sanitize(v: Column) -> Column:
    """NaN, infinities and null count as 0."""
    v = v.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf), 0.0).otherwise(v)


def normalize(v: Column, low: Column, high: Column) -> Column:
    """Place within [low, high], clamped to [0, 1]; 0 where the range is empty."""
    return F.when(high <= low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low))))


def linear(x: Column) -> Column:
    return x


def log(x: Column, base: float = 1000.0) -> Column:
    return F.when(x <= 0, 0.0).otherwise(F.log(1 + x * (base - 1)) / math.log(base))


def sqrt(x: Column) -> Column:
    return F.sqrt(x)


def asinh(x: Column, softening: float = 0.1) -> Column:
    return F.asinh(x / softening) / math.asinh(1 / softening)


def sinh(x: Column, q: float = 3.0) -> Column:
    return F.sinh(x * q) / math.sinh(q)


def mtf(x: Column, midtone: Column | float = 0.5) -> Column:
    """Midtone transfer: a lower midtone brightens."""
    m = F.greatest(F.lit(0.001), F.least(F.lit(0.999), midtone if isinstance(midtone, Column) else F.lit(float(midtone))))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(F.abs(m - 0.5) < 0.001, x).otherwise((m - 1) * x / ((2 * m - 1) * x - m))
