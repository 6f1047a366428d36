"""Cone search, positional joins by sky tiles, joins by the latest time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tileindex import order_for, surrounded, tile_index
from ..session import spread

#: Right rows whose tiles one task works out, and those whose pairs one task makes.
ROWS, PAIRS = 20_000, 5_000


def cone_search(catalog: DataFrame, ra0: float, dec0: float, radius_arcsec: float, key: str, limit: int = 1000, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Rows within the radius, nearest first, with `dist` in degrees. The declination band reaches the scan as a plain comparison."""
    r = radius_arcsec / 3600
    near = catalog.where(F.col(dec).between(dec0 - r, dec0 + r)).withColumn("dist", G.separation(ra0, dec0, F.col(ra), F.col(dec)))
    return near.where(F.col("dist") <= r).orderBy("dist", key).limit(limit)


def cross_match(left: DataFrame, right: DataFrame, radius_deg: float) -> DataFrame:
    """All pairs within the radius. left: lid, ra, dec; right: rid, ra, dec. (lid, rid, dist); rows without a place meet nothing.

    A left row goes to its tile, a right row to its own and the eight around it, at the finest order
    whose ring of neighbours holds the radius: an equality join with nine keys a row everywhere, at the poles as well.
    Beyond 35 degrees a right row goes to all twelve base cells. Both sides are dealt by tile into tasks of about PAIRS
    right rows; one that has few bytes is not broadcast. Pairs are told apart by the chord between them, a little too long,
    before their distance is worked out.
    """
    order = order_for(radius_deg)
    n = F.lit(1 << max(order, 0)).cast("long")
    pix = tile_index(F.col("ra"), F.col("dec"), n, "standard")
    there = F.col("ra").isNotNull() & F.col("dec").isNotNull()
    ra, dec = F.radians("ra"), F.radians("dec")
    places = lambda k: (F.col("ra").alias(f"ra{k}"), dec.alias(f"d{k}"), F.cos(dec).alias(f"c{k}"), (F.cos(dec) * F.cos(ra)).alias(f"x{k}"), (F.cos(dec) * F.sin(ra)).alias(f"y{k}"), F.sin(dec).alias(f"z{k}"))
    right = spread(right.where(there), ROWS)
    tasks = max(1, math.ceil(right.count() / PAIRS))
    a = spread(left.where(there), ROWS).select("lid", *places(1), F.explode(F.array(pix)).alias("pix")).repartition(tasks, "pix")
    b = right.select("rid", *places(2), pix.alias("own"))
    b = surrounded(b, "own", 1 << order, "pix") if order >= 0 else b.withColumn("pix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    b = b.repartition(tasks, "pix")
    chord = 4 * math.sin(math.radians(min(radius_deg, 180.0)) / 2) ** 2 + 1e-9
    apart = lambda k: (F.col(f"{k}1") - F.col(f"{k}2")) * (F.col(f"{k}1") - F.col(f"{k}2"))
    # G.separation, with what depends on one side worked out before
    a2 = F.pow(F.sin((F.col("d2") - F.col("d1")) / 2), 2) + F.col("c1") * F.col("c2") * F.pow(F.sin(F.radians(F.col("ra2") - F.col("ra1")) / 2), 2)
    d = F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a2))))
    near = b.join(a.hint("shuffle_hash"), "pix").where(apart("x") + apart("y") + apart("z") <= chord)
    return near.withColumn("dist", d).where(F.col("dist") <= radius_deg).select("lid", "rid", "dist")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, slice_width: float | None = None) -> DataFrame:
    """left: key, time, ...; right: key, time, value. left with the latest value not after its time: one union, one window.

    slice_width: in units of time; a key is then split into slices, so that one with very many rows is
    no single task. The last value of each slice (one row a slice) is carried on to the later ones.
    """
    columns = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, *columns, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(key, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    slot = F.floor(F.col(time) / slice_width) if slice_width else F.lit(0)
    both = a.unionByName(b).withColumn("__slice", slot)
    order = Window.partitionBy(key, "__slice").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__side = 1").drop("__v", "__side")
    if not slice_width:
        return own.drop("__slice")
    ends = both.groupBy(key, "__slice").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(time))).alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    carried = ends.select(key, "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__carry"))
    return own.join(carried, [key, "__slice"]).withColumn(value, F.coalesce(value, "__carry")).drop("__slice", "__carry")
