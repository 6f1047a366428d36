"""Tile sets on disk: properties files and tile files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordtext import trimmed

#: What absent properties count as.
DEFAULTS = {"title": "", "hips_order": "3", "tile_format": "png", "frame": "equatorial", "tile_width": "512"}


def properties(text: Column) -> Column:
    """map of the key = value lines; comments and lines without = are skipped, of equal keys the last counts."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (F.length(x) > 0) & ~x.startswith("#") & F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("key"), trimmed(F.substring(x, F.instr(x, "=") + 1, F.lit(1 << 30))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse_properties(text: Column) -> dict[str, Column]:
    p = properties(text)
    whole = lambda key: F.when(F.map_contains_key(p, key), F.regexp_extract(p[key], r"^[+-]?\d+", 0).try_cast("int")).otherwise(int(DEFAULTS[key.replace("hips_tile", "tile")]))
    return {
        "title": F.coalesce(p["obs_title"], p["creator_did"], F.lit(DEFAULTS["title"])), "hips_order": whole("hips_order"), "tile_format": F.coalesce(p["hips_tile_format"], F.lit(DEFAULTS["tile_format"])),
        "frame": F.coalesce(p["hips_frame"], F.lit(DEFAULTS["frame"])), "tile_width": whole("hips_tile_width"),
    }


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), *(c.alias(k) for k, c in parse_properties(F.col("value")).items()))


def read_tiles(spark: SparkSession, root: str, formats: tuple[str, ...] = ("png", "jpg", "fits")) -> DataFrame:
    """(ord, pix, format, length, content) of the tile files below a root; order and index come from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "Npix*").load(root)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return files.select(part(r"/Norder(\d+)/").cast("int").alias("ord"), part(r"/Npix(\d+)\.").cast("long").alias("pix"), part(r"\.(\w+)$").alias("format"), "length", "content").where(F.col("format").isin(*formats))


def write_pixels(rgba: DataFrame, path: str) -> None:
    """Sink of coloured pixels, by image."""
    rgba.write.mode("overwrite").partitionBy("image").parquet(path)
