"""Registered image functions, run as Pandas functions over packed images."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Upscale = Callable[[np.ndarray, int, int, int], np.ndarray]
_HOOKS: dict[str, Upscale] = {}


def register(name: str, function: Upscale) -> None:
    """function(data, width, height, factor) -> data of the larger image."""
    _HOOKS[name] = function


def registered() -> list[str]:
    """A copy: changing it changes nothing."""
    return list(_HOOKS)


def clear() -> None:
    _HOOKS.clear()


def apply(images: DataFrame, name: str, factor: int, out: str = "upscaled") -> DataFrame:
    """images: w, h, data. Arrow batches of whole images."""
    function = _HOOKS[name]

    @F.pandas_udf("array<double>")
    def run(data: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(function(np.asarray(d, float), int(a), int(b), factor), float) for d, a, b in zip(data, w, h, strict=True)])

    return images.withColumn(out, run("data", "w", "h"))
