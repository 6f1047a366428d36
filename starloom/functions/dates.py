"""Modified Julian Dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_EPOCH_MJD = 40587


def mjd_to_date(mjd: Column) -> Column:
    """The UTC date on which the instant falls."""
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(mjd).cast("int"))


def to_mjd(ts: Column) -> Column:
    """Of a timestamp, or of one without zone taken as UTC (the session's zone must be UTC for that)."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000.0 + UNIX_EPOCH_MJD


def token_expiry(token: Column) -> Column:
    """Expiry claim, in seconds, of a three-part token."""
    body = F.try_element_at(F.split(token, r"\."), F.lit(2))
    padded = F.rpad(F.translate(body, "-_", "+/"), F.ceil(F.length(body) / 4) * 4, F.lit("="))
    return F.get_json_object(F.unbase64(padded).cast("string"), "$.exp").cast("double")
