"""Tables as the sky model sees them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import STOPS
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as images: priority is the image, key the pixel index, price the value."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("image"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("embedding").cast("array<double>").alias("data"))


def sky(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """customers as objects on the sky; with `rows` they are dealt into tasks of so many before their places are worked out."""
    k = F.col("c_custkey").cast("double")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return (spread(customers, rows) if rows else customers).select(
        F.col("c_custkey").alias("id"), F.round(F.pmod(k * 137.50776405, F.lit(360.0)), 6).alias("ra"), F.round(F.degrees(F.asin(F.pmod(k * 0.7548776662, F.lit(1.0)) * 1.98 - 0.99)), 6).alias("dec"), F.col("c_acctbal").alias("mag"), F.col("c_mktsegment").alias("kind")
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as named objects."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("description"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations."""
    from ..functions.dates import to_mjd

    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("object_id"), to_mjd(F.col("ts")).alias("mjd"), F.col("event_type").alias("band"), F.col("value").alias("magnitude"))


PX = "px AS (SELECT o_orderpriority AS image, o_orderkey AS idx, o_totalprice AS v FROM orders)"
RG = "rg AS (SELECT image, CASE WHEN count(*) > 100 THEN list_sort(list(v))[CAST(floor(0.01e0 * (count(*) - 1)) AS BIGINT) + 1] ELSE min(v) END AS low, CASE WHEN count(*) > 100 THEN list_sort(list(v))[CAST(floor(0.99e0 * (count(*) - 1)) AS BIGINT) + 1] ELSE max(v) END AS high FROM px GROUP BY image)"
NX = "nx AS (SELECT px.image, idx, v, low, high, CASE WHEN high <= low THEN 0e0 ELSE greatest(0e0, least(1e0, (v - low) / (high - low))) END AS x FROM px JOIN rg USING (image))"
SKY = "sky AS (SELECT c_custkey AS id, round((c_custkey * 137.50776405e0) % 360e0, 6) AS ra, round(degrees(asin(((c_custkey * 0.7548776662e0) % 1e0) * 1.98e0 - 0.99e0)), 6) AS dec, c_acctbal AS mag, c_mktsegment AS kind FROM customer)"
OBJ = "obj AS (SELECT p_partkey AS ord, 'P' || p_partkey AS id, p_name AS name, p_type AS category, p_brand AS description FROM part)"
EP = "ep AS (SELECT event_id, user_id AS object_id, epoch_us(ts) / 86400000000e0 + 40587 AS mjd, event_type AS band, value AS magnitude FROM events)"


def channel_sql(t: str, name: str, c: int) -> str:
    stops, cases = STOPS[name], []
    cases.append(f"WHEN {t} <= {stops[0][0]} THEN {float(stops[0][c])!r}")
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        cases.append(f"WHEN {t} <= {b[0]} THEN {a[c]}e0 + ({t} - {a[0]}e0) / ({b[0]}e0 - {a[0]}e0) * ({b[c]} - {a[c]})")
    return f"CAST(floor((CASE {' '.join(cases)} ELSE {float(stops[-1][c])!r} END) + 0.5e0) AS INTEGER)"


def wrap_sql(x: str) -> str:
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def sep_sql(ra0: str, dec0: str, ra: str, dec: str) -> str:
    return f"degrees(2 * asin(sqrt(least(1e0, pow(sin((radians({dec}) - radians({dec0})) / 2), 2) + cos(radians({dec0})) * cos(radians({dec})) * pow(sin(radians({ra} - ({ra0})) / 2), 2)))))"
