"""Nested sky-tile indices as column expressions.

mode "reference" divides the belt's longitude by a full turn and so reaches only four of its
faces; it is kept for parity. mode "standard" is the published HEALPix form, with cells of equal
area over the whole sphere, and the one to join and partition by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each byte with its bits on the even places of two bytes, and each byte's four even bits together.
SPREAD = [sum((v >> i & 1) << 2 * i for i in range(8)) for v in range(256)]
COMPACT = [sum((v >> 2 * i & 1) << i for i in range(4)) for v in range(256)]


def nside(order: Column) -> Column:
    return F.pow(F.lit(2.0), order).cast("long")


def _listed(values) -> Column:
    """A literal array as one expression; column by column it would be a call to the JVM for each entry."""
    return F.expr(f"array({', '.join(map(str, values))})")


def _by_byte(table: list[int], v: Column, places: int, shift: int) -> Column:
    """The entries of each byte of v, side by side; few uses of v, which may be a long expression."""
    entries = _listed(table)
    part = lambda k: F.shiftleft(F.element_at(entries, F.shiftright(v, 8 * k).bitwiseAND(255).cast("int") + 1).cast("long"), shift * k)
    out = part(0)
    for k in range(1, places):
        out = out.bitwiseOR(part(k))
    return out


def spread_bits(v: Column) -> Column:
    """The low 16 bits on the even places."""
    return _by_byte(SPREAD, v.cast("long"), 2, 16)


def compact_bits(v: Column) -> Column:
    """The even bits of the low 32 together."""
    return _by_byte(COMPACT, v.cast("long"), 4, 4)


def interleave(x: Column, y: Column) -> Column:
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))


def face_xy(pix: Column, n: Column) -> tuple[Column, Column, Column]:
    """Face, x and y of a nested index."""
    local = pix % (n * n)
    return F.floor(pix / (n * n)), compact_bits(local), compact_bits(F.shiftright(local, 1))


def latitude(dec: Column, n: Column) -> dict[str, Column]:
    """What an index needs of a declination: z, and how many lines from its pole it is. Places of one declination share it."""
    z = F.cos(math.pi / 2 - F.radians(dec))
    return {"z": z, "reach": n * F.sqrt(3 * (1 - F.abs(z)))}


def index_at(phi: Column, z: Column, reach: Column, n: Column, mode: str = "reference") -> Column:
    """Nested index of the longitude phi (radians, 0 to a full turn) at a `latitude`. The arguments recur, so long expressions are better columns."""
    if mode not in ("reference", "standard"):
        raise ValueError(f"unknown mode {mode!r}")
    turn = phi / (2 * math.pi) if mode == "reference" else phi / (math.pi / 2)
    # belt: counts of ascending and descending lines
    up, down = F.floor(n * (0.5 + turn - z * 0.75)), F.floor(n * (0.5 + turn + z * 0.75))
    col, row = F.floor(up / n), F.floor(down / n)
    belt = F.when(col == row, col % 4 + 4).when(col < row, col % 4).otherwise(row % 4 + 8)
    belt_x, belt_y = down % n, n - up % n - 1
    # caps: lines counted from the pole within a quarter
    quarter = F.least(F.floor(phi / (math.pi / 2)), F.lit(3))
    part = phi / (math.pi / 2) - quarter
    a = F.least(F.greatest(F.floor(part * reach), F.lit(0)), n - 1)
    b = F.least(F.greatest(F.floor((1 - part) * reach), F.lit(0)), n - 1)
    north = z > 0
    in_belt = F.abs(z) <= 2 / 3
    face = F.when(in_belt, belt).when(north, quarter).otherwise(quarter + 8)
    x = F.when(in_belt, belt_x).when(north, n - b - 1).otherwise(a)
    y = F.when(in_belt, belt_y).when(north, n - a - 1).otherwise(b)
    return (face * n * n + interleave(x, y)).cast("long")


def tile_index(ra: Column, dec: Column, n: Column, mode: str = "reference") -> Column:
    """Nested index of a sky place at n cells a face side."""
    return index_at(F.radians(F.pmod(ra, F.lit(360.0))), **latitude(dec, n), n=n, mode=mode)


#: Steps beyond a base cell of the northern (0), middle (1) and southern (2) row: to which row, how many columns east, and the
#: new x and y as multiples of x, y, the side n and 1. Near a pole the axes turn on the way.
_STAY = (0, 0), (1, 0, 0, 0), (0, 1, 0, 0)
NORTH_EAST, SOUTH_WEST, NORTH_WEST, SOUTH_EAST = range(1, 5)
_STEPS = {
    (0, NORTH_EAST): ((0, 1), (0, 1, 0, 0), (-1, 0, 2, -1)), (0, SOUTH_WEST): ((1, 0), (1, 0, 1, 0), (0, 1, 0, 0)), (0, NORTH_WEST): ((0, -1), (0, -1, 2, -1), (1, 0, 0, 0)), (0, SOUTH_EAST): ((1, 1), (1, 0, 0, 0), (0, 1, 1, 0)),
    (1, NORTH_EAST): ((0, 0), (1, 0, -1, 0), (0, 1, 0, 0)), (1, SOUTH_WEST): ((2, -1), (1, 0, 1, 0), (0, 1, 0, 0)), (1, NORTH_WEST): ((0, -1), (1, 0, 0, 0), (0, 1, -1, 0)), (1, SOUTH_EAST): ((2, 0), (1, 0, 0, 0), (0, 1, 1, 0)),
    (2, NORTH_EAST): ((1, 1), (1, 0, -1, 0), (0, 1, 0, 0)), (2, SOUTH_WEST): ((2, -1), (0, 1, 0, 0), (-1, 0, 0, -1)), (2, NORTH_WEST): ((1, 0), (1, 0, 0, 0), (0, 1, -1, 0)), (2, SOUTH_EAST): ((2, 1), (0, -1, 0, -1), (1, 0, 0, 0)),
}


def _stepped(at: DataFrame, kept: list[Column], n: int) -> DataFrame:
    """Cells (__f, __x, __y) whose x, or else y, is beyond their base cell, as seen from the base cell there."""
    entries = [((row, 0),) + _STAY[1:] if not way else _STEPS[row, way] for row in range(3) for way in range(5)]
    x, y, f = F.col("__x"), F.col("__y"), F.col("__f")
    way = F.when(x >= n, NORTH_EAST).when(x < 0, SOUTH_WEST).when(y >= n, NORTH_WEST).when(y < 0, SOUTH_EAST).otherwise(0)
    picked = at.select(*kept, f, x, y, (F.floor(f / 4) * 5 + way + 1).cast("int").alias("__k"))
    of = lambda values: F.element_at(_listed(values), F.col("__k"))
    mixed = lambda i: of(e[i][0] for e in entries) * x + of(e[i][1] for e in entries) * y + of(e[i][2] * n + e[i][3] for e in entries)
    face = of(e[0][0] for e in entries) * 4 + F.pmod(f + of(e[0][1] for e in entries), F.lit(4))
    return picked.select(*kept, face.cast("long").alias("__f"), mixed(1).cast("long").alias("__x"), mixed(2).cast("long").alias("__y"))


def surrounded(rows: DataFrame, pix: str, n: int, out: str) -> DataFrame:
    """Each row once for its cell (mode "standard", n cells a face side) and once for every neighbour of it, which `out` names: nine rows, eight where three base cells meet. Across edges of base cells and poles too.

    A place within RING of a cell's side of another is in the other's cell or one of its neighbours.
    """
    side, kept = F.lit(n).cast("long"), [F.col(f"`{c}`") for c in rows.columns if c != out]
    steps = F.explode(F.array(*(F.struct(F.lit(dx).cast("long").alias("x"), F.lit(dy).cast("long").alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    face, x, y = face_xy(F.col(pix), side)
    at = rows.withColumns({"__f": face.cast("long"), "__x": x, "__y": y}).select("*", steps.alias("__d"))
    at = at.select(*kept, "__f", (F.col("__x") + F.col("__d.x")).alias("__x"), (F.col("__y") + F.col("__d.y")).alias("__y"), F.col("__d.x").alias("__dx"), F.col("__d.y").alias("__dy"))
    # there is no cell across a corner of three base cells: north and south of one of the belt, east and west of the others
    beyond = lambda c: (F.col(c) < 0) | (F.col(c) >= side)
    at = at.where(~(beyond("__x") & beyond("__y") & ((F.floor(F.col("__f") / 4) == 1) == (F.col("__dx") == F.col("__dy")))))
    for _ in range(2):  # one axis, then the other
        at = _stepped(at, kept, n)
    cell = (F.col("__f") * side * side + interleave(F.col("__x"), F.col("__y"))).cast("long")
    # unfolded, so that what is asked of the result stays above it: pushed down it would copy all steps into itself
    return at.select(*kept, F.explode(F.array(cell)).alias(out))


#: Mean side of a base cell in degrees, and the part of a cell's side that is surely within its ring of neighbours (found to be 0.70).
SIDE, RING = 58.6323, 0.6


def order_for(radius: float, most: int = 15) -> int:
    """The finest order at which places within the radius (degrees) are in one cell or in neighbours; -1 if there is none."""
    return max((k for k in range(most + 1) if RING * SIDE / (1 << k) >= radius), default=-1)


def tile_url(order: Column, pix: Column, fmt: Column | str = "png", base: Column | str = "") -> Column:
    """base/Norder../Dir../Npix..; a trailing /properties or / of the base is dropped."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    root = F.regexp_replace(F.regexp_replace(lit(base), "/properties$", ""), "/$", "")
    folder = (F.floor(pix / 10000) * 10000).cast("long")
    return F.concat(root, F.lit("/Norder"), order.cast("string"), F.lit("/Dir"), folder.cast("string"), F.lit("/Npix"), pix.cast("string"), F.lit("."), lit(fmt))
