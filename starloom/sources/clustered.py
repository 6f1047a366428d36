"""Catalogs written in the order of their sky tiles, so that a cone reads only the files that it meets.

Rows are dealt by ranges of the nested index (and a hash of the row, so that a place with very many
rows is several files), sorted within files, one folder a range. A small table beside them says which
indices each folder holds; it has a row per file, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.cover import INDEX_ORDER, cover
from ..functions.tileindex import tile_index
from ..operators.matching import cone_search

ROWS_PER_FILE = 1_000_000
PIX, PART = "tile_pix", "tile_part"


def write_clustered(catalog: DataFrame, path: str, ra: str = "ra", dec: str = "dec", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes the catalog below `path`; rows without a place are kept and found by no cone."""
    pix = tile_index(F.col(ra), F.col(dec), F.lit(1 << INDEX_ORDER).cast("long"), "standard")
    spark, files = catalog.sparkSession, max(1, -(-catalog.count() // rows_per_file))
    dealt = catalog.withColumn(PIX, pix).repartitionByRange(files, PIX, F.xxhash64(ra, dec, *catalog.columns[:1]))
    dealt.sortWithinPartitions(PIX).withColumn(PART, F.spark_partition_id()).write.partitionBy(PART).option("compression", "zstd").parquet(f"{path}/rows")
    dealt.where("false").write.parquet(f"{path}/schema")
    held = _rows(spark, path).groupBy(PART).agg(F.min(PIX).alias("first"), F.max(PIX).alias("last"), F.count("*").alias("n"))
    held.coalesce(1).write.parquet(f"{path}/parts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows; a catalog without rows has no folder, so the schema stands apart."""
    schema = spark.read.parquet(f"{path}/schema").schema.add(PART, IntegerType())
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def meets(first: Column, last: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out |= (last >= a) & (first <= b)
    return out


def rows_near(spark: SparkSession, path: str, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """The rows of all tiles that a circle meets. Folders are picked before the scan, row groups within them by their indices."""
    ranges = cover(ra, dec, radius_deg)
    parts = [r[0] for r in spark.read.parquet(f"{path}/parts").where(meets(F.col("first"), F.col("last"), ranges)).select(PART).collect()]
    return _rows(spark, path).where(F.col(PART).isin(parts) & meets(F.col(PIX), F.col(PIX), ranges)).drop(PIX, PART)


def clustered_cone(spark: SparkSession, path: str, ra0: float, dec0: float, radius_arcsec: float, key: str, limit: int = 1000, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """`cone_search` on a catalog written by write_clustered."""
    return cone_search(rows_near(spark, path, ra0, dec0, radius_arcsec / 3600), ra0, dec0, radius_arcsec, key, limit, ra, dec)
