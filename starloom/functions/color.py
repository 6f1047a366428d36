"""Colour maps, luma, inversion and compositing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stretch import js_round

#: Stops (t, red, green, blue) of each colour map.
STOPS: dict[str, list[tuple[float, int, int, int]]] = {
    "grayscale": [(0, 0, 0, 0), (1, 255, 255, 255)],
    "viridis": [(0, 68, 1, 84), (0.13, 72, 36, 117), (0.25, 56, 88, 140), (0.38, 39, 126, 142), (0.5, 31, 161, 135), (0.63, 74, 194, 109), (0.75, 159, 218, 58), (0.88, 223, 227, 24), (1, 253, 231, 37)],
    "plasma": [(0, 13, 8, 135), (0.13, 84, 2, 163), (0.25, 139, 10, 165), (0.38, 185, 50, 137), (0.5, 219, 92, 104), (0.63, 244, 136, 73), (0.75, 254, 188, 43), (0.88, 240, 230, 33), (1, 240, 249, 33)],
    "inferno": [(0, 0, 0, 4), (0.13, 40, 11, 84), (0.25, 101, 21, 110), (0.38, 159, 42, 99), (0.5, 212, 72, 66), (0.63, 245, 125, 21), (0.75, 250, 193, 39), (0.88, 230, 240, 91), (1, 252, 255, 164)],
    "hot": [(0, 0, 0, 0), (0.33, 255, 0, 0), (0.67, 255, 255, 0), (1, 255, 255, 255)],
    "cool": [(0, 0, 255, 255), (1, 255, 0, 255)],
    "red": [(0, 0, 0, 0), (1, 255, 0, 0)],
    "green": [(0, 0, 0, 0), (1, 0, 255, 0)],
    "blue": [(0, 0, 0, 0), (1, 0, 0, 255)],
}


def within(t: Column) -> Column:
    """t held to 0..1; null and NaN count as 0."""
    return F.when(t.isNull() | F.isnan(t), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def segment(t: Column, stops: list[tuple[float, int, int, int]]) -> Column:
    """Number, from 1, of the segment between stops that holds t of 0..1; the channels share it."""
    return reduce(lambda a, b: a + b, ((t > low[0]).cast("int") for low in stops[1:-1]), F.lit(1))


def channel(t: Column, place: Column, stops: list[tuple[float, int, int, int]], c: int) -> Column:
    """One channel (1 red, 2 green, 3 blue) at t of 0..1 in its segment."""
    segments = list(zip(stops[:-1], stops[1:], strict=True))
    listed = lambda values: F.expr(f"array({', '.join(f'{x!r}D' for x in values)})")
    pick = lambda values: F.lit(values[0]) if len(values) == 1 else F.element_at(listed(values), place)
    start, width, base, rise = (pick(x) for x in zip(*((float(a[0]), float(b[0] - a[0]), float(a[c]), float(b[c] - a[c])) for a, b in segments), strict=True))
    return js_round(base + (t - start) / width * rise).cast("int")


def color(t: Column, name: str) -> Column:
    """struct(r, g, b, a) of a colour map, by name or given as stops."""
    stops = STOPS[name] if isinstance(name, str) else name
    t = within(t)
    place = segment(t, stops)
    return F.struct(*(channel(t, place, stops, k).alias(c) for k, c in enumerate("rgb", 1)), F.lit(255).alias("a"))


def stop_table(spark: SparkSession) -> DataFrame:
    """(map, t, r, g, b): a row for each colour map, its stops as arrays."""
    rows = [(name, *([float(x[0]) for x in stops], *([x[c] for x in stops] for c in (1, 2, 3)))) for name, stops in STOPS.items()]
    return spark.createDataFrame(rows, "map string, t array<double>, r array<int>, g array<int>, b array<int>")


def color_of(t: Column, stops: str, channels: tuple[str, ...] = ("r", "g", "b")) -> Column:
    """struct(r, g, b, a) by the stops of the row, a column struct(t, r, g, b); one expression for all maps."""
    t, at = within(t), F.col(f"{stops}.t")
    place = F.size(F.filter(F.slice(at, 2, F.size(at) - 2), lambda x: x < t)) + 1
    part = (t - F.element_at(at, place)) / (F.element_at(at, place + 1) - F.element_at(at, place))
    one = lambda c: js_round(F.element_at(c, place) + part * (F.element_at(c, place + 1) - F.element_at(c, place))).cast("int")
    return F.struct(*(one(F.col(f"{stops}.{c}")).alias(c) for c in channels), F.lit(255).alias("a"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def invert(c: Column) -> Column:
    return 255 - c


def over(bottom: Column, layers: list[tuple[Column, Column]]) -> Column:
    """Source-over of (value, opacity in percent) layers, first at the bottom."""
    return reduce(lambda dst, layer: dst * (1 - layer[1] / 100.0) + layer[0] * (layer[1] / 100.0), layers, bottom)


def over_array(bottom: Column, layers: Column) -> Column:
    """The same for an ordered array of struct(value, opacity)."""
    return F.aggregate(layers, bottom.cast("double"), lambda dst, x: dst * (1 - x["opacity"] / 100.0) + x["value"] * (x["opacity"] / 100.0))
