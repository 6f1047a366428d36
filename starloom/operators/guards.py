"""Row guards: which rows have the shape that a record type asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import resample
from .catalog import CATALOGS

#: Names that the record types allow.
BANDS = ("u", "g", "r", "i", "z", "y")
TILE_FORMATS = ("png", "jpg", "fits")
COLOR_MAPS = ("grayscale", "viridis", "plasma", "inferno", "hot", "cool", "red", "green", "blue")
METHODS = ("linear", "log", "sqrt", "asinh", "sinh", "mtf", "histogram", "zscale", "percentile")
STATUSES = ("completed", "executing", "error")


def every(*flags: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, flags), F.lit(False))


def one_of(c: Column, values: tuple[str, ...]) -> Column:
    """Case counts."""
    return F.coalesce(c.isin(*values), F.lit(False))


def present(*columns: Column) -> Column:
    return every(*(c.isNotNull() for c in columns))


def optional_number(text: Column) -> Column:
    """Absent, or a number in text form."""
    return text.isNull() | text.try_cast("double").isNotNull()


def is_coordinates(ra: Column, dec: Column) -> Column:
    return present(ra, dec)


def is_photometry(bands: Column) -> Column:
    """bands: map<string, double>; all six keys, values may be null."""
    return every(*(F.map_contains_key(bands, b) for b in BANDS))


def is_catalog_name(c: Column) -> Column:
    return one_of(c, CATALOGS)


def is_cone(ra: Column, dec: Column, radius: Column, catalog: Column) -> Column:
    return every(present(ra, dec, radius), is_catalog_name(catalog))


def is_light_curve_point(mjd: Column, magnitude: Column, error: Column, band: Column, exposure: Column) -> Column:
    return present(mjd, magnitude, error, band, exposure)


def is_catalog_object(object_id: Column, ra: Column, dec: Column, bands: Column) -> Column:
    return every(object_id.isNotNull(), is_coordinates(ra, dec), is_photometry(bands))


def is_tap_result(status: Column, row_count: Column, columns: Column, rows: Column) -> Column:
    return every(one_of(status, STATUSES), present(row_count, columns, rows))


def is_method(c: Column) -> Column:
    return one_of(c, METHODS)


def is_color_map(c: Column) -> Column:
    return one_of(c, COLOR_MAPS)


def is_interpolation(c: Column) -> Column:
    return one_of(c, resample.METHODS)


def is_tile(order: Column, pix: Column, url: Column, fmt: Column) -> Column:
    return every(present(order, pix, url), one_of(fmt, TILE_FORMATS))


def is_tile_properties(title: Column, order: Column, fmt: Column, frame: Column, width: Column) -> Column:
    return present(title, order, fmt, frame, width)


def is_scaling(method: Column, *numbers: Column) -> Column:
    """numbers: as text; each absent or a number."""
    return every(is_method(method), *(optional_number(n) for n in numbers))


def is_view(ra: Column, dec: Column, zoom: Column, method: Column, color_map: Column) -> Column:
    return every(present(ra, dec, zoom), is_method(method), is_color_map(color_map))


def is_epoch(mjd: Column, iso_date: Column) -> Column:
    return present(mjd, iso_date)
