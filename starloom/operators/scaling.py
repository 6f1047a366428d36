"""Display ranges and the scaling of images held in long form: one row per pixel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stretch as S
from ..session import written
from .ranks import nearest_rank, positions

CLIP_ABOVE, EQUALIZE_BINS = 100, 65_536
ZSCALE_SAMPLE, ZSCALE_CONTRAST, ZSCALE_ROUNDS, ZSCALE_REJECT, ZSCALE_FLAT = 10_000, 0.25, 5, 2.5, 1e-30


@dataclass(frozen=True)
class Scaling:
    """method and its numbers; low and high override either side of the range."""

    method: str = "linear"
    low: float | None = None
    high: float | None = None
    low_percentile: float = 0.0
    high_percentile: float = 100.0
    log_base: float = 1000.0
    softening: float | None = None
    midtone: float | None = None
    contrast: float = ZSCALE_CONTRAST

    def __post_init__(self):
        if self.method not in S.METHODS:
            raise ValueError(f"unknown method {self.method!r}")


def clean(pixels: DataFrame, image: str, index: str, value: str) -> DataFrame:
    return pixels.select(F.col(image).alias("image"), F.col(index).alias("idx"), F.col(value).cast("double").alias("raw"), S.sanitize(F.col(value)).alias("v"))


def display_range(rows: DataFrame) -> DataFrame:
    """(image, low, high): 1 % and 99 % of images with more than 100 pixels, else least and greatest."""
    r = nearest_rank(rows, ["image"], "v", {"p1": (0.01, "gaps"), "p99": (0.99, "gaps")})
    return r.select("image", F.when(F.col("n") > CLIP_ABOVE, F.col("p1")).otherwise(F.col("least")).alias("low"), F.when(F.col("n") > CLIP_ABOVE, F.col("p99")).otherwise(F.col("most")).alias("high"))


def percentile_range(rows: DataFrame, low: float, high: float) -> DataFrame:
    r = nearest_rank(rows, ["image"], "v", {"a": (low / 100, "gaps"), "b": (high / 100, "gaps")})
    return r.select("image", F.col("a").alias("low"), F.col("b").alias("high"))


def zscale_fit(sample: np.ndarray, contrast: float) -> tuple[float, float]:
    """Range of a sorted sample of positive values: a line through rank and value, outliers rejected round by round."""
    n = len(sample)
    if n < 3:
        return float(sample[0]), float(sample[-1])
    mid = n // 2
    x = np.arange(n) - float(mid)
    on, slope = np.ones(n, bool), 0.0
    for _ in range(ZSCALE_ROUNDS):
        count = int(on.sum())
        if count < 2:
            break
        mx, my = x[on].mean(), sample[on].mean()
        spread = ((x[on] - mx) ** 2).sum()
        slope = float(((x[on] - mx) * (sample[on] - my)).sum() / spread) if spread else 0.0
        off = sample - (my + slope * (x - mx))
        sigma = float(np.sqrt((off[on] ** 2).sum() / (count - 1)))
        if sigma < ZSCALE_FLAT:
            break
        bad = on & (np.abs(off) > ZSCALE_REJECT * sigma)
        if not bad.any():
            break
        on &= ~bad
    if on.sum() < n / 2:
        return float(sample[0]), float(sample[-1])
    tilt = slope / contrast
    z1, z2 = sample[mid] + tilt * (1 - mid), sample[mid] + tilt * (n - mid)
    return float(max(sample[0], min(z1, z2))), float(min(sample[-1], max(z1, z2)))


def zscale_range(rows: DataFrame, contrast: float = ZSCALE_CONTRAST) -> DataFrame:
    """(image, low, high) from at most ZSCALE_SAMPLE positive pixels an image, every n-th in pixel order; 0 and 0 without any."""
    ranked = positions(rows.where("v > 0"), ["image"], "idx")
    count = written(ranked.groupBy("image").agg(F.count("*").alias("n")))
    pos, n, most = F.col("pos"), F.col("n"), F.lit(ZSCALE_SAMPLE)
    nearby = F.ceil(pos * most / n)  # the only sample number that can take this position
    take = (n <= most) | ((F.floor(nearby * n / most) == pos) & (nearby < most))
    sample = ranked.join(count, "image").where(take).select("image", "v")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        low, high = zscale_fit(np.sort(part["v"].to_numpy()), contrast)
        return pd.DataFrame({"image": [part["image"].iloc[0]], "low": [low], "high": [high]})

    kind = rows.schema["image"].dataType.simpleString()
    found = sample.groupBy("image").applyInPandas(fit, f"image {kind}, low double, high double")  # bounded: the sample
    return written(rows.select("image").distinct().join(found, "image", "left").select("image", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high")))


def equalized(rows: DataFrame) -> DataFrame:
    """The rows with low, high (the display range) and `scaled` by the cumulative histogram between the 1 % and 99 % values; one pass for all four ranks."""
    r = nearest_rank(rows, ["image"], "v", {"p1": (0.01, "items"), "p99": (0.99, "items"), "g1": (0.01, "gaps"), "g99": (0.99, "gaps")})
    r = r.select("image", "p1", "p99", F.when(F.col("n") > CLIP_ABOVE, F.col("g1")).otherwise(F.col("least")).alias("low"), F.when(F.col("n") > CLIP_ABOVE, F.col("g99")).otherwise(F.col("most")).alias("high"))
    span = F.col("p99") - F.col("p1")
    index = F.least(F.lit(EQUALIZE_BINS - 1), F.floor((F.col("v") - F.col("p1")) / span * (EQUALIZE_BINS - 1)))
    binned = rows.join(r, "image").withColumn("bin", F.when((span > 0) & F.col("v").between(F.col("p1"), F.col("p99")), index))
    counts = binned.where("bin is not null").groupBy("image", "bin").count()  # at most EQUALIZE_BINS an image
    order = Window.partitionBy("image").orderBy("bin")
    cdf = counts.select("image", "bin", (F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("count").over(Window.partitionBy("image"))).alias("cdf"))
    joined = binned.join(cdf, ["image", "bin"], "left")
    scaled = F.when(span <= 0, 0.5).when(F.col("v") <= F.col("p1"), 0.0).when(F.col("v") >= F.col("p99"), 1.0).otherwise(F.col("cdf"))
    return joined.withColumn("scaled", scaled).select(*rows.columns, "low", "high", "scaled")


def ranges(rows: DataFrame, p: Scaling) -> DataFrame:
    if p.method == "zscale":
        r = zscale_range(rows, p.contrast)
    elif p.method == "percentile":
        r = percentile_range(rows, p.low_percentile, p.high_percentile)
    else:
        r = display_range(rows)
    low = F.col("low") if p.low is None else F.lit(float(p.low))
    high = F.col("high") if p.high is None else F.lit(float(p.high))
    return r.select("image", low.alias("low"), high.alias("high"))


def midtones(placed: DataFrame) -> DataFrame:
    """(image, midtone): the median of x (between the two middle values of an even number), kept off the ends; 0.5 for an empty range."""
    ranged = placed.select("image", (F.col("high") > F.col("low")).alias("wide"), "x")  # an image has one range
    r = nearest_rank(ranged, ["image", "wide"], "x", {"a": (0.5, "gaps"), "b": (0.5, "items")})
    return r.select("image", F.when(F.col("wide"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), (F.col("a") + F.col("b")) / 2))).otherwise(0.5).alias("midtone"))


def apply_scaling(pixels: DataFrame, p: Scaling, image: str = "image", index: str = "idx", value: str = "value") -> DataFrame:
    """image, idx, v (clean value), low, high, scaled in [0, 1], is_underflow, is_overflow: one row per pixel.

    Two stages: a range for each image, then one projection over the pixels.
    """
    rows = clean(pixels, image, index, value)
    if p.method == "histogram":
        flat = F.lit(False)
        return equalized(rows).select("image", "idx", "v", "low", "high", "scaled", flat.alias("is_underflow"), flat.alias("is_overflow"))
    joined = rows.join(ranges(rows, p), "image").withColumn("x", S.normalize(F.col("v"), F.col("low"), F.col("high")))
    x = F.col("x")
    if p.method == "mtf":
        if p.midtone is None:
            joined = joined.join(midtones(joined), "image")
            y = S.mtf(x, F.col("midtone"))
        else:
            y = S.mtf(x, p.midtone)
    else:
        y = {"log": lambda: S.log(x, p.log_base), "asinh": lambda: S.asinh(x, 0.1 if p.softening is None else p.softening), "sinh": lambda: S.sinh(x, 3.0 if p.softening is None else p.softening), "sqrt": lambda: S.sqrt(x)}.get(p.method, lambda: x)()
    return joined.select("image", "idx", "v", "low", "high", y.alias("scaled"), (F.col("v") < F.col("low")).alias("is_underflow"), (F.col("v") > F.col("high")).alias("is_overflow"))


def flag_counts(scaled: DataFrame) -> DataFrame:
    """Per image how many pixels lie outside the range on either side, the first below and the last above."""
    under, over = F.col("is_underflow"), F.col("is_overflow")
    return scaled.groupBy("image").agg(F.count_if(under).alias("n_under"), F.count_if(over).alias("n_over"), F.min(F.when(under, F.col("idx"))).alias("first_under"), F.max(F.when(over, F.col("idx"))).alias("last_over"))


def flag_lists(scaled: DataFrame) -> DataFrame:
    """Per image the pixel indices outside the range, ascending (as a result for display, small by nature)."""
    return scaled.groupBy("image").agg(F.array_sort(F.collect_list(F.when(F.col("is_underflow"), F.col("idx")))).alias("underflow"), F.array_sort(F.collect_list(F.when(F.col("is_overflow"), F.col("idx")))).alias("overflow"))
