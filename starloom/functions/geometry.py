"""Angles, projections and view arithmetic as column expressions; degrees throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stretch import js_round

TILE_PIXELS, MAX_ORDER, MAX_ZOOM = 512, 13, 18.0
MINIMAP = (120.0, 60.0)
#: Fields of view above which a grid spacing holds.
SPACINGS = [(40.0, 10.0), (20.0, 5.0), (10.0, 2.0), (5.0, 1.0), (2.0, 0.5), (1.0, 0.2), (0.5, 0.1), (0.2, 0.05)]
FINEST_SPACING = 0.02


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def wrap(ra: Column) -> Column:
    return F.pmod(ra, F.lit(360.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zoom_fov(zoom: Column) -> Column:
    return 180.0 / F.pow(F.lit(2.0), zoom)


def zoom_order(zoom: Column) -> Column:
    return F.least(F.lit(MAX_ORDER), F.greatest(F.lit(0), js_round(zoom))).cast("int")


def zoom_by(zoom: Column, step: float) -> Column:
    return clamp(zoom + step, 0.0, MAX_ZOOM)


def cos_separation(ra0, dec0, ra: Column, dec: Column) -> Column:
    d0, d = F.radians(col(dec0)), F.radians(dec)
    return F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(F.radians(ra - col(ra0)))


def project(ra: Column, dec: Column, ra0, dec0, fov, width, height) -> tuple[Column, Column]:
    """Gnomonic place in pixels; null behind the viewer."""
    d0, d, da = F.radians(col(dec0)), F.radians(dec), F.radians(ra - col(ra0))
    c = cos_separation(ra0, dec0, ra, dec)
    scale = col(width) / F.radians(col(fov))
    u = F.cos(d) * F.sin(da) / c
    v = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / c
    return F.when(c > 0.01, col(width) / 2 + u * scale), F.when(c > 0.01, col(height) / 2 - v * scale)


def unproject(x: Column, y: Column, ra0, dec0, fov, width, height, pan_x=0.0, pan_y=0.0) -> tuple[Column, Column]:
    """Sky place of a pixel, a pan offset undone."""
    d0, scale = F.radians(col(dec0)), col(width) / F.radians(col(fov))
    u = (x - col(pan_x) - col(width) / 2) / scale
    v = -(y - col(pan_y) - col(height) / 2) / scale
    rho = F.sqrt(u * u + v * v)
    c = F.atan(rho)
    safe = F.when(rho == 0, 1.0).otherwise(rho)
    dec = F.degrees(F.asin(F.cos(c) * F.sin(d0) + v * F.sin(c) * F.cos(d0) / safe))
    ra = col(ra0) + F.degrees(F.atan2(u * F.sin(c), rho * F.cos(c) * F.cos(d0) - v * F.sin(c) * F.sin(d0)))
    return wrap(ra), dec


def tile_angle(order: Column) -> Column:
    return 180.0 / F.pow(F.lit(2.0), order)


def tile_on_screen(ra: Column, dec: Column, order: Column, ra0, dec0, fov, width, height) -> dict[str, Column]:
    """Centre, half size, rotation and visibility of a tile on the canvas."""
    c = cos_separation(ra0, dec0, ra, dec)
    x, y = project(ra, dec, ra0, dec0, fov, width, height)
    half = tile_angle(order) / 2
    east = ra + half / F.cos(F.radians(dec))
    ex, ey = project(east, dec, ra0, dec0, fov, width, height)
    margin = 2.0 * TILE_PIXELS
    seen = (c > 0.05) & x.between(-margin, col(width) + margin) & y.between(-margin, col(height) + margin) & ex.isNotNull()
    return {"x": x, "y": y, "half_size": F.radians(half) / c * (col(width) / F.radians(col(fov))), "rotation": F.atan2(ey - y, ex - x), "visible": F.coalesce(seen, F.lit(False))}


def minimap(ra: Column, dec: Column, fov: Column) -> dict[str, Column]:
    """The view's rectangle on the whole-sky map; its width shrinks with cos(dec)."""
    w, h = MINIMAP
    wide = fov * F.cos(F.radians(dec))
    return {"x": (ra - wide / 2) / 360 * w, "y": (90 - dec - fov / 2) / 180 * h, "w": wide / 360 * w, "h": fov / 180 * h}


def minimap_sky(x: Column, y: Column) -> tuple[Column, Column]:
    w, h = MINIMAP
    return clamp(x, 0.0, w) / w * 360, 90 - clamp(y, 0.0, h) / h * 180


def grid_spacing(fov: Column) -> Column:
    out = F.when(fov > SPACINGS[0][0], SPACINGS[0][1])
    for least, spacing in SPACINGS[1:]:
        out = out.when(fov > least, spacing)
    return out.otherwise(FINEST_SPACING)


def grid_lines(center: Column, fov: Column, spacing: Column) -> Column:
    """Line places within the view, rounded to 3 digits."""
    first = F.ceil((center - fov / 2) / spacing)
    last = F.floor((center + fov / 2) / spacing + 1e-9)
    return F.when(last < first, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(first, F.greatest(first, last)), lambda k: js_round(k * spacing, 3)))


def scale_bar(fov: Column) -> Column:
    """Length in arc minutes, rounded to a plain number."""
    arcmin = fov * 60 / 400 * 80
    return F.when(arcmin >= 60, js_round(arcmin / 30) * 30.0).when(arcmin >= 10, js_round(arcmin / 5) * 5.0).when(arcmin >= 1, js_round(arcmin).cast("double")).otherwise(js_round(arcmin * 10) / 10)


def pan_keys(ra: Column, dec: Column, fov: Column, dx: int, dy: int) -> tuple[Column, Column]:
    """One arrow key: a quarter of the view; declination stays short of the poles."""
    return wrap(ra + fov / 4 * dx), clamp(dec + fov / 4 * dy, -89.99, 89.99)


def pan_to(ra: Column, dec: Column) -> tuple[Column, Column]:
    return wrap(ra), clamp(dec, -90.0, 90.0)


def separation(ra0, dec0, ra: Column, dec: Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    d0, d = F.radians(col(dec0)), F.radians(dec)
    a = F.pow(F.sin((d - d0) / 2), 2) + F.cos(d0) * F.cos(d) * F.pow(F.sin(F.radians(ra - col(ra0)) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))))
