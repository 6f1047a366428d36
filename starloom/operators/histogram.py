"""Fixed-width histograms with every bin kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

CHART_HEIGHT, CHART_MARGIN = 80, 4


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 64, keys: list[str] | None = None) -> DataFrame:
    """(keys, bin, x0, x1, n): the top edge belongs to the last bin; values outside and NaN are dropped; no row for an empty range."""
    keys = keys or []
    v = F.col(value).cast("double")
    if high <= low:
        return df.limit(0).select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.lit(0).cast("long").alias("n"))
    width = (high - low) / bins
    counts = df.where(v.between(low, high) & ~F.isnan(v)).groupBy(*keys, F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).count()
    groups = df.select(*keys).distinct() if keys else df.select(F.lit(1).alias("__one")).distinct()
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).drop("__one")
    edge = lambda k: low + (F.col("bin") + k) * width
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", edge(0).alias("x0"), edge(1).alias("x1"), F.coalesce("count", F.lit(0)).alias("n"))


def histogram_by(df: DataFrame, value: str, ranges: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """The same with a range for each group: ranges has a row (keys, low, high) for each; groups without one, or with an empty one, have no bars."""
    v, low, high = F.col(value).cast("double"), F.col("low"), F.col("high")
    some = written(ranges.where(high > low).select(*keys, low.cast("double").alias("low"), high.cast("double").alias("high")).withColumn("width", (high - low) / bins))  # so few groups are sent to the rows
    inside = df.select(*keys, v.alias("__v")).join(some, keys).where(F.col("__v").between(low, high) & ~F.isnan("__v"))
    counts = inside.groupBy(*keys, F.least(F.floor((F.col("__v") - low) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin")).count()
    spine = some.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: low + (F.col("bin") + k) * F.col("width")
    return spine.join(counts, [*keys, "bin"], "left").select(*keys, "bin", edge(0).alias("x0"), edge(1).alias("x1"), F.coalesce("count", F.lit(0)).alias("n"))


def bar_heights(bars: DataFrame, keys: list[str] | None = None, stretch: tuple[float, float] | None = None) -> DataFrame:
    """The bins with their height in pixels and, for a stretch, whether they lie within it."""
    keys = keys or []
    most = bars.groupBy(*keys).agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("most"))
    joined = bars.join(most, keys) if keys else bars.crossJoin(F.broadcast(most))  # one row
    out = joined.withColumn("height", F.col("n") / F.col("most") * (CHART_HEIGHT - CHART_MARGIN)).drop("most")
    return out.withColumn("in_range", (F.col("x0") >= stretch[0]) & (F.col("x1") <= stretch[1])) if stretch else out


def move_handle(value: Column, other: Column, side: str) -> Column:
    """A dragged handle stays on its side of the other."""
    return F.least(value, other) if side == "low" else F.greatest(value, other)


def handle_percent(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low) * 100
