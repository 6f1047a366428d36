"""Observation epochs: neighbours, blinking, counters, generated sequences, light curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import mjd_to_date
from ..functions.stretch import js_round
from .ranks import nearest_rank
from .sequences import sliced

BASE_MJD, SPACING, JITTER = 60_000, 25, 5.0


def _there(place: str, other: Column) -> Column:
    """The item at a neighbouring place, or another one where there is none."""
    return F.when(F.col(place).isNull(), other).otherwise(F.col(place)["item"])


def steps(epochs: DataFrame, keys: list[str], item: str, order: list[str], slice_width: float | None = None) -> DataFrame:
    """prev_item and next_item without wrapping, clamped to the ends, and blink_item, which goes on from the last to the first; all of one pass. slice_width: see `sequences.sliced`."""
    s = sliced(epochs, keys, order, item, slice_width)
    return s.select(prev_item=_there("__before", F.col(item)), next_item=_there("__after", F.col(item)), blink_item=_there("__after", F.col("__leader")["item"]))


def neighbours(epochs: DataFrame, keys: list[str], item: str, order: list[str], slice_width: float | None = None) -> DataFrame:
    """prev_item and next_item, without wrapping, clamped to the ends."""
    s = sliced(epochs, keys, order, item, slice_width)
    return s.select(prev_item=_there("__before", F.col(item)), next_item=_there("__after", F.col(item)))


def blink(epochs: DataFrame, keys: list[str], item: str, order: list[str], slice_width: float | None = None) -> DataFrame:
    """next_item, the last one going on to the first."""
    return sliced(epochs, keys, order, item, slice_width).select(next_item=_there("__after", F.col("__leader")["item"]))


def counters(epochs: DataFrame, keys: list[str], order: list[str], shown: int = 5, slice_width: float | None = None) -> DataFrame:
    """place, total, label "k / n", whether the row is among the first `shown`, and how many more there are."""
    s = sliced(epochs, keys, order, order[0], slice_width)
    place, total = F.col("__place"), F.col("__total")
    return s.select(place=place, total=total, label=F.concat_ws(" / ", place.cast("string"), total.cast("string")), is_shown=place <= shown, more=F.greatest(total - shown, F.lit(0)))


def _jittered(k: Column, seed: int | None) -> Column:
    return js_round(BASE_MJD + k * SPACING + F.rand(seed) * JITTER - JITTER / 2, 2)


def _band(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(b) for b in "gri")), (k % 3 + 1).cast("int"))


def generated(spark: SparkSession, count: int = 30, seed: int | None = None) -> DataFrame:
    """(mjd, iso_date, band): about every 25 days, bands in turn."""
    return spark.range(count).select(_jittered(F.col("id"), seed).alias("mjd"), _band(F.col("id")).alias("band")).withColumn("iso_date", mjd_to_date(F.col("mjd"))).select("mjd", "iso_date", "band").orderBy("mjd")


def generated_for(objects: DataFrame, key: str, count: str, seed: int | None = None) -> DataFrame:
    """The same for every object, as many epochs as `count` says: (key, k from 0, mjd, iso_date, band). The spacing exceeds the jitter, so k is the place by mjd as well."""
    each = objects.where(F.col(count) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).alias("k"))
    return each.withColumns({"mjd": _jittered(F.col("k"), seed), "band": _band(F.col("k"))}).select(key, "k", "mjd", mjd_to_date(F.col("mjd")).alias("iso_date"), "band")


def light_curve_summary(points: DataFrame) -> DataFrame:
    """Extension: per object and band count, span and magnitudes. points: object_id, band, mjd, magnitude."""
    return points.groupBy("object_id", "band").agg(F.count("*").alias("n"), F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"), F.min("magnitude").alias("brightest"), F.avg("magnitude").alias("mean_magnitude"))


def composite(points: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Extension: bands as channels. points: object_id, band, value; channels: r, g, b -> band."""
    wide = points.groupBy("object_id").pivot("band", sorted(set(channels.values()))).agg(F.avg("value"))
    return wide.select("object_id", *(F.col(f"`{b}`").alias(c) for c, b in channels.items()))


def median_stack(images: DataFrame) -> DataFrame:
    """Extension: per pixel the median over images, the mean of the two middle values of an even number. images: label, data array<double>.

    The two middle ranks are picked by `nearest_rank`, so a stack of any number of images is spread over tasks.
    """
    cells = images.select("label", F.posexplode("data").alias("idx", "v"))
    middle = nearest_rank(cells, ["label", "idx"], "v", {"low": (0.5, "gaps"), "high": (0.5, "items")})
    return middle.select("label", "idx", ((F.col("low") + F.col("high")) / 2).alias("median"), "n")
