"""Coordinates in text: parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stretch import js_round

#: What counts as a number, the two sexagesimal patterns of each mode, and the messages.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LENIENT_RA, LENIENT_DEC = r"(?i)(\d+)h\s*(\d+)?m?\s*([\d.]+)?s?", r"(?i)([+-]?\d+)d?\s*(\d+)?m?\s*([\d.]+)?s?"
STRICT_RA, STRICT_DEC = r"(?i)(\d+)h\s*(?:(\d+)m)?\s*(?:(\d+(?:\.\d+)?)s)?", r"(?i)([+-]?\d+)d\s*(?:(\d+)m)?\s*(?:(\d+(?:\.\d+)?)s)?"
RA_ERROR, DEC_ERROR = "RA must be 0-360", "Dec must be -90 to 90"
LENIENT_ERROR = "Enter coords or object name (e.g. M42)"
STRICT_ERROR = "Enter RA,Dec (e.g. 62.0,-37.0) or sexagesimal (e.g. 4h8m0s -37d0m0s)"


#: What counts as white space at the ends of a text.
BLANK = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def number(text: Column) -> Column:
    """A decimal number, else null; the guard keeps out suffixes that a cast would take."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.coalesce(F.regexp_extract(found, r"^\d*\.?\d*", 0).try_cast("double"), F.lit(0.0))


def parse(text: Column, mode: str = "lenient") -> dict[str, Column]:
    """ra, dec and error of a coordinate text: a decimal pair first, then sexagesimal. Blank text gives three nulls."""
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    q = trimmed(text)
    parts = F.filter(F.split(q, r"[,\s]+"), lambda x: F.length(x) > 0)
    a, b = number(F.try_element_at(parts, F.lit(1))), number(F.try_element_at(parts, F.lit(2)))
    pair = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    error = F.when(~a.between(0, 360), RA_ERROR).when(~b.between(-90, 90), DEC_ERROR)
    ra_pattern, dec_pattern = (LENIENT_RA, LENIENT_DEC) if mode == "lenient" else (STRICT_RA, STRICT_DEC)
    has_ra = q.rlike(ra_pattern)
    rest = q
    if mode == "lenient":  # the declination is looked for behind as many characters as the match has
        rest = F.when(has_ra, F.substring(q, F.length(F.regexp_extract(q, ra_pattern, 0)) + 1, F.lit(1 << 30))).otherwise(q)
    sexagesimal = has_ra & rest.rlike(dec_pattern)
    ra = (_part(q, ra_pattern, 1) + _part(q, ra_pattern, 2) / 60 + _part(q, ra_pattern, 3) / 3600) * 15
    whole = F.regexp_extract(rest, dec_pattern, 1)
    degrees = F.abs(whole.try_cast("double")) + _part(rest, dec_pattern, 2) / 60 + _part(rest, dec_pattern, 3) / 3600
    dec = F.when(whole.startswith("-"), -degrees).otherwise(degrees)
    blank = F.length(q) == 0
    return {
        "ra": F.when(blank, None).when(pair & error.isNull(), a).when(~pair & sexagesimal, ra),
        "dec": F.when(blank, None).when(pair & error.isNull(), b).when(~pair & sexagesimal, dec),
        "error": F.when(blank, None).when(pair, error).when(~sexagesimal, LENIENT_ERROR if mode == "lenient" else STRICT_ERROR),
    }


def fixed(x: Column, digits: int) -> Column:
    """A number that is not negative with so many digits, half going up."""
    scaled = F.floor(x * 10**digits + 0.5).cast("long")
    whole = F.floor(scaled / 10**digits).cast("long").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((scaled % 10**digits).cast("string"), digits, "0")) if digits else whole


def signed(x: Column, digits: int) -> Column:
    return F.concat(F.when((x < 0) & (F.floor(F.abs(x) * 10**digits + 0.5) > 0), "-").otherwise(""), fixed(F.abs(x), digits))


def exponential(x: Column, digits: int = 3) -> Column:
    """d.ddde+n for a number other than 0."""
    a = F.abs(x)
    e = F.floor(F.log10(a))
    m = js_round(a / F.pow(F.lit(10.0), e), digits)
    e, m = F.when(m >= 10, e + 1).otherwise(e).cast("int"), F.when(m >= 10, m / 10).otherwise(m)
    text = F.concat(F.when(x < 0, "-").otherwise(""), fixed(m, digits), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
    return F.when(x == 0, "0." + "0" * digits + "e+0").otherwise(text)


def _pad(x: Column, n: int) -> Column:
    return F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def _split(x: Column) -> tuple[Column, Column, Column]:
    """Units, minutes and seconds."""
    minutes = (x - F.floor(x)) * 60
    return F.floor(x), F.floor(minutes), (minutes - F.floor(minutes)) * 60


def format_ra(ra: Column) -> Column:
    h, m, s = _split(ra / 15)
    return F.concat(_pad(_whole(h), 2), F.lit("h"), _pad(_whole(m), 2), F.lit("m"), _pad(fixed(s, 2), 5), F.lit("s"))


def format_dec(dec: Column) -> Column:
    d, m, s = _split(F.abs(dec))
    return F.concat(F.when(dec >= 0, "+").otherwise("-"), _pad(_whole(d), 2), F.lit("d"), _pad(_whole(m), 2), F.lit("m"), _pad(fixed(s, 1), 4), F.lit("s"))


def format_degrees(x: Column, axis: str) -> Column:
    """Plain text of an angle without padding: hours for "ra", signed degrees for "dec"."""
    v = x / 15 if axis == "ra" else F.abs(x)
    d = F.floor(v)
    m = F.floor((v - d) * 60)
    s = (v - d) * 3600 - m * 60
    if axis == "ra":
        return F.concat(_whole(d), F.lit("h "), _whole(m), F.lit("m "), signed(s, 2), F.lit("s"))
    return F.concat(F.when(x >= 0, "+").otherwise("-"), _whole(d), F.lit("° "), _whole(m), F.lit("' "), signed(s, 1), F.lit('"'))


def format_grid(x: Column, axis: str) -> Column:
    """Label of a grid line: minutes are cut off."""
    v = x / 15 if axis == "ra" else F.abs(x)
    m = _pad(_whole((v - F.floor(v)) * 60), 2)
    if axis == "ra":
        return F.concat(_whole(v), F.lit("h"), m, F.lit("m"))
    return F.concat(F.when(x >= 0, "+").otherwise("-"), _whole(v), F.lit("°"), m, F.lit("'"))


def format_scale(arcmin: Column) -> Column:
    return F.when(arcmin >= 60, F.concat(fixed(arcmin / 60, 1), F.lit("°"))).when(arcmin < 1, F.concat(fixed(arcmin, 1), F.lit("'"))).otherwise(F.concat(fixed(arcmin, 0), F.lit("'")))


def format_magnitude(m: Column) -> Column:
    return F.concat(F.lit("m"), signed(m, 1))
