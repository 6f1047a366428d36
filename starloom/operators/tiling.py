"""Sky tiles: which are in view, where their centres are, which are not loaded yet."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tileindex import face_xy, index_at, latitude, tile_index
from ..session import spread, written


#: Views that one task unfolds, some hundred tiles each.
VIEWS = 5_000
#: The same where the tiles are shuffled behind it: each task opens a file for every partition of the shuffle, so there are fewer of them; what a task keeps is bounded by the tiles, not by its views.
SHARED_VIEWS = 50_000


def _nine_places(angle: Column) -> Column:
    """An angle of 0 and more, rounded to nine places as the SQL does; `round` would turn each number into text and back."""
    return F.floor(angle * 1e9 + 0.5) / 1e9


def _in_view(views: DataFrame, mode: str) -> DataFrame:
    """(view_id, ord, pix), with repeats; the right ascension steps are bounded at the poles."""
    angle = G.tile_angle(F.col("ord"))
    radius = F.col("fov") / 2 + angle * 2
    turn = F.pow(F.lit(2.0), F.col("ord"))  # offsets of as many tiles close the circle
    cos = F.cos(F.radians(F.col("dec")))
    wide = F.when(F.abs(cos) < 1e-12, turn).otherwise(F.least(turn, F.ceil(radius / cos / angle)))
    steps = views.select("view_id", "ord", "ra", "dec", angle.alias("angle"), F.greatest(F.lit(1), F.ceil(radius / angle)).cast("int").alias("rows"), F.greatest(F.lit(1), wide).cast("int").alias("columns"))
    grid = steps.withColumn("i", F.explode(F.sequence(-F.col("rows"), F.col("rows")))).withColumn("tile_dec", F.col("dec") + F.col("i") * F.col("angle")).where(F.col("tile_dec").between(-90, 90))
    # what a row's places share is worked out before they are unfolded, what an index uses more than once is a column
    grid = grid.withColumn("tile_dec", F.round("tile_dec", 9)).withColumn("n", F.pow(F.lit(2), F.col("ord")).cast("long")).withColumns(latitude(F.col("tile_dec"), F.col("n")))
    grid = grid.withColumn("j", F.explode(F.sequence(-F.col("columns"), F.col("columns"))))
    place = _nine_places(G.wrap(F.col("ra") + F.col("j") * F.col("angle")))
    grid = grid.withColumn("phi", F.radians(F.pmod(place, F.lit(360.0))))
    return grid.select("view_id", "ord", index_at(F.col("phi"), F.col("z"), F.col("reach"), F.col("n"), mode).alias("pix"))


def visible_tiles(views: DataFrame, mode: str = "reference") -> DataFrame:
    """views: view_id, ra, dec, fov, ord. (view_id, ord, pix), distinct: views are dealt by their id, so their tiles are made distinct where they are unfolded and never shuffled."""
    return _in_view(spread(views, VIEWS, "view_id"), mode).distinct()


def tiles_in_view(views: DataFrame, mode: str = "reference") -> DataFrame:
    """(ord, pix) of all tiles that any view sees, distinct: each task hands on a tile once, however many of its views see it."""
    return _in_view(spread(views, SHARED_VIEWS), mode).select("ord", "pix").distinct()


def unloaded_tiles(views: DataFrame, loaded: Column, mode: str = "reference") -> DataFrame:
    """(ord, pix) of the tiles that only views see for whose view_id `loaded` does not hold; one pass, and no tile is kept by view."""
    tiles = _in_view(spread(views, SHARED_VIEWS), mode).groupBy("ord", "pix").agg(F.max(F.coalesce(loaded, F.lit(False))).alias("loaded"))
    return tiles.where("NOT loaded").select("ord", "pix")


def tile_centers(spark: SparkSession, order: int, mode: str = "reference") -> DataFrame:
    """(ord, pix, ra, dec) of all reachable tiles of an order, by one pass over a grid of quarter tiles.

    Of the grid's places in a tile the one nearest to the equator and to longitude 0 counts. Rows of
    declination are dealt out, each unfolds into its places where it is, and tiles are aggregated
    before they are shuffled; order 13 has 805 million tiles.
    """
    if not 0 <= order <= G.MAX_ORDER:
        raise ValueError(f"orders go from 0 to {G.MAX_ORDER}")
    side = 1 << order
    step = 180.0 / side / 4
    rows = spark.range(0, int(180 / step) + 1, 1, max(1, side // 4)).select((F.col("id") * step - 90).alias("dec"))
    cos = F.cos(F.radians("dec"))
    stride = step / F.least(F.lit(1.0), F.abs(cos) + 0.1)
    grid = rows.withColumn("stride", stride).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(360.0) / F.col("stride")).cast("int") - 1))).withColumn("ra", F.col("k") * F.col("stride")).where("ra < 360")
    distance = F.col("dec") * F.col("dec") + F.least(F.col("ra"), 360 - F.col("ra")) * 0.1
    pix = tile_index(F.col("ra"), F.col("dec"), F.lit(side).cast("long"), mode)
    return grid.select(pix.alias("pix"), "ra", "dec", distance.alias("d")).groupBy("pix").agg(F.min_by(F.struct("ra", "dec"), F.struct("d", "dec", "ra")).alias("c")).select(F.lit(order).alias("ord"), "pix", "c.ra", "c.dec")


def _regions(face: Column, x: Column, y: Column, n: Column) -> Column:
    """Where on the sky (mode "reference") places of a tile can be: an array of structs (low, high: declination; west, east: right ascension), a little too wide. At most one in the belt and one in a cap."""
    span = lambda low, high, west, east: F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), west.cast("double").alias("west"), east.cast("double").alias("east"))
    dec = lambda z: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))
    # belt: the tile lies between two rising and two falling lines, of which the faces 0, 4, 5 and 8 have these
    up = F.when(face.isin(0, 4), 0).when(face.isin(5, 8), 1) * n + (n - 1 - y)
    down = F.when(face.isin(4, 8), 0).when(face.isin(0, 5), 1) * n + x
    turn = lambda d: 360 * ((up + down + d) / (2 * n) - 0.5)
    belt = F.when(up.isNotNull(), span(dec((down - up - 1) / (1.5 * n)), dec((down - up + 1) / (1.5 * n)), turn(0), turn(2)))
    # caps: `near` rings from the pole, a part of the quarter
    north = face < 4
    a, b = F.when(north, n - 1 - y).otherwise(x), F.when(north, n - 1 - x).otherwise(y)
    near, far = a + b, F.least(a + b + 2, n)
    z = lambda reach: 1 - reach * reach / (3.0 * n * n)
    quarter = 90 * (face % 4)
    west, east = quarter + 90 * F.least(F.lit(1.0), a / F.greatest(far, F.lit(1))), quarter + F.when(near > 0, 90 * F.least(F.lit(1.0), (a + 1) / near)).otherwise(90)
    cap = F.when(~face.isin(4, 5, 6, 7) & (near <= n), F.when(north, span(dec(z(far)), dec(z(near)), west, east)).otherwise(span(-dec(z(near)), -dec(z(far)), west, east)))
    return F.array_compact(F.array(belt, cap))


#: Tiles whose centres one task searches for.
TILES = 1_000


def centers_of(tiles: DataFrame) -> DataFrame:
    """tiles: ord (0 to 13), pix, distinct. (ord, pix, ra, dec) of each by the rule of `tile_centers` (mode "reference"), (0, 0) if unreachable.

    Only the grid's places about each tile are looked at: a few rows of some ten places, in the rings next to a pole
    up to a fifth of the tiles of a side. Work grows with the tiles that are asked for, not with 4 ** ord.
    """
    tiles = spread(written(tiles.select("ord", "pix")), TILES, "ord", "pix")
    n = F.pow(F.lit(2), F.col("ord")).cast("long")
    step = F.lit(180.0) / n / 4
    face, x, y = face_xy(F.col("pix"), F.col("n"))
    cells = tiles.select("ord", "pix", n.alias("n"), step.alias("step")).withColumns({"face": face, "x": x, "y": y})
    area = cells.select("ord", "pix", "n", "step", F.inline(_regions(F.col("face"), F.col("x"), F.col("y"), F.col("n"))))
    row = F.sequence(F.greatest(F.lit(0), F.floor((F.col("low") + 90) / F.col("step")) - 1).cast("int"), F.least(4 * F.col("n"), F.ceil((F.col("high") + 90) / F.col("step")) + 1).cast("int"))
    rows = area.withColumn("i", F.explode(row)).withColumn("dec", F.col("i") * F.col("step") - 90)
    stride = F.col("step") / F.least(F.lit(1.0), F.abs(F.cos(F.radians("dec"))) + 0.1)
    rows = rows.withColumn("stride", stride).withColumn("last", F.ceil(F.lit(360.0) / F.col("stride")).cast("int") - 1)
    first = F.least(F.col("last"), F.greatest(F.lit(0), F.floor(F.col("west") / F.col("stride")).cast("int") - 1))
    upto = F.greatest(first, F.least(F.col("last"), F.ceil(F.col("east") / F.col("stride")).cast("int") + 1))
    place = F.transform(F.sequence(first, upto), lambda k: F.struct((k * F.col("stride")).alias("ra"), F.col("dec").alias("dec")))
    places = rows.select("ord", "pix", "n", F.inline(place)).where("ra < 360")
    distance = F.col("dec") * F.col("dec") + F.least(F.col("ra"), 360 - F.col("ra")) * 0.1
    hit = places.where(tile_index(F.col("ra"), F.col("dec"), F.col("n")) == F.col("pix")).select("ord", "pix", "ra", "dec", distance.alias("d"))
    found = hit.groupBy("ord", "pix").agg(F.min_by(F.struct("ra", "dec"), F.struct("d", "dec", "ra")).alias("c"))  # where the tiles were dealt to
    return with_centers(tiles, found.select("ord", "pix", "c.ra", "c.dec").hint("shuffle_hash"))


def with_centers(tiles: DataFrame, centers: DataFrame) -> DataFrame:
    """Tiles with their centres; unreachable ones get (0, 0)."""
    return tiles.join(centers, ["ord", "pix"], "left").fillna(0.0, ["ra", "dec"])


def missing_tiles(visible: DataFrame, cached: DataFrame) -> DataFrame:
    return visible.join(cached, ["ord", "pix"], "left_anti")


def failure_alert(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """attempts: keys, ok. Attempts, failures, and whether more than five and more than half failed."""
    bad = F.count_if(~F.col("ok"))
    return attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), bad.alias("failures")).withColumn("alert", (F.col("failures") > 5) & (F.col("failures") / F.col("attempts") > 0.5))


def points_to_tiles(points: DataFrame, order: int, mode: str = "standard", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Points with their tile, for equi-joins and partitioning."""
    return points.withColumn("pix", tile_index(F.col(ra), F.col(dec), F.lit(1 << order).cast("long"), mode))


def order_for(zoom: float) -> int:
    return min(G.MAX_ORDER, max(0, math.floor(zoom + 0.5)))
