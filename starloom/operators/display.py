"""From colour pixels to the screen: luma, scaling, colour map, inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from .scaling import Scaling, apply_scaling


def display(pixels: DataFrame, scaling: Scaling = Scaling(), color_map: str = "grayscale", inverted: bool = False) -> DataFrame:
    """pixels: image, idx, r, g, b. The same columns as shown.

    Linear, grayscale and not inverted leaves the colours alone; anything else goes through the luma.
    """
    if scaling.method == "linear" and color_map == "grayscale" and not inverted:
        return pixels.select("image", "idx", "r", "g", "b")
    grey = pixels.withColumn("value", C.luma(F.col("r"), F.col("g"), F.col("b")))
    shown = apply_scaling(grey, scaling).withColumn("c", C.color(F.col("scaled"), color_map))
    flip = C.invert if inverted else (lambda c: c)
    return shown.select("image", "idx", *(flip(F.col(f"c.{k}")).alias(k) for k in "rgb"))
