"""Cells that cover a circle on the sky, as ranges of nested indices (mode "standard").

A circle is few numbers, so the cover is made where the query is built: cells are split into four
from the twelve base cells on, until they lie inside, outside, or are small against the radius.
"""

from __future__ import annotations

import math

#: Deepest order of the index column; its cells are a quarter of an arc minute wide.
INDEX_ORDER = 13
#: Cells are split until they are this part of the radius, and no finer than the index.
FINENESS = 0.25


def place(face: int, u: float, v: float) -> tuple[float, float]:
    """Right ascension and declination of the place (u, v), each from 0 to 1, on a base cell; u grows to the north-east, v to the north-west."""
    row, column = divmod(face, 4)
    down = row + 2 - u - v  # from the north pole, in base cells
    across = 2 * column + (row != 1) + u - v  # in eighths of the circle
    if down < 1 or down > 3:
        near = down if down < 1 else 4 - down
        z = (1 - near * near / 3) * (1 if down < 1 else -1)
        middle = 2 * column + 1
        across = middle + (u - v) / near if near > 0 else float(middle)
    else:
        z = (2 - down) * 2 / 3
    return (across * 45.0) % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, z))))


def separation(ra0: float, dec0: float, ra: float, dec: float) -> float:
    a = math.sin(math.radians(dec - dec0) / 2) ** 2 + math.cos(math.radians(dec0)) * math.cos(math.radians(dec)) * math.sin(math.radians(ra - ra0) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(a))))


def bound(face: int, x: int, y: int, side: int) -> tuple[float, float, float]:
    """Centre of a cell and a radius that holds it whole."""
    at = lambda i, j: place(face, (x + i) / side, (y + j) / side)
    ra, dec = at(0.5, 0.5)
    edge = max(separation(ra, dec, *at(i, j)) for i in (0, 0.5, 1) for j in (0, 0.5, 1))
    return ra, dec, edge * 1.05 + 1e-9


def cover(ra: float, dec: float, radius: float, order: int = INDEX_ORDER, most: int = 64) -> list[tuple[int, int]]:
    """Ranges (first, last) of indices at `order` that hold every place within the radius (degrees); at most `most` of them, the narrowest gaps closed."""
    found: list[tuple[int, int]] = []
    stack = [(face, 0, 0, 0, face) for face in range(12)]
    while stack:
        face, depth, x, y, pix = stack.pop()
        c_ra, c_dec, size = bound(face, x, y, 1 << depth)
        distance = separation(ra, dec, c_ra, c_dec)
        if distance > radius + size:
            continue
        if distance + size <= radius or depth == order or size <= FINENESS * radius:
            width = 4 ** (order - depth)
            found.append((pix * width, (pix + 1) * width - 1))
        else:
            stack += [(face, depth + 1, 2 * x + i, 2 * y + j, 4 * pix + i + 2 * j) for i in (0, 1) for j in (0, 1)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a == merged[-1][1] + 1:
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    while len(merged) > most:
        gap, k = min((merged[i + 1][0] - merged[i][1], i) for i in range(len(merged) - 1))
        merged[k : k + 2] = [(merged[k][0], merged[k + 1][1])]
    return merged
