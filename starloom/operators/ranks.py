"""Exact order statistics and positions without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Groups up to this size are ranked whole; in larger ones only values near the wanted rank are.
SMALL = 20_000
#: Rank error of the approximate percentile, as a share of the group, and the margin taken for it.
ACCURACY, MARGIN = 10_000, 3e-4


def nearest_rank(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Per group: n, least, most and, for each name in `wanted`, the value at a rank counted from 0.

    wanted: name -> (p, rule): rule "gaps" is floor(p * (n - 1)), rule "items" floor(p * n), both
    within the group. An approximate percentile with a proven error brackets each rank; below the bracket values are
    only counted, and only those inside are sorted. No value is collected.

    What there is one row a group of is written, here and in the result: its size is then known, so that few groups are
    sent to the rows. Joins by group would bring a group's rows together in one task, or send the rows of a well compressed table.
    """
    v = F.col(value)
    names = list(wanted)
    low = [max(0.0, wanted[x][0] - MARGIN) for x in names]
    high = [min(1.0, wanted[x][0] + MARGIN) for x in names]
    n = F.col("n")
    stats = df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile_approx(v, low, ACCURACY).alias("low"), F.percentile_approx(v, high, ACCURACY).alias("high"))

    def rank(x: str) -> Column:
        p, rule = wanted[x]
        return F.greatest(F.lit(0), F.least(n - 1, F.floor(p * (n - 1) if rule == "gaps" else p * n)))

    small = n <= SMALL
    brackets = F.array(*(F.struct(F.lit(x).alias("name"), rank(x).alias("rank"), F.when(small, F.col("least")).otherwise(F.col("low")[i]).alias("low"), F.when(small, F.col("most")).otherwise(F.col("high")[i]).alias("high")) for i, x in enumerate(names)))
    bounds = written(stats).select(*keys, "n", "least", "most", F.explode(brackets).alias("b")).select(*keys, "n", "least", "most", "b.*")
    rows = df.select(*keys, v.alias("__v")).where("__v is not null").join(bounds, keys).where("__v <= high")
    # what is below the bracket is one null row a group, first in order
    counted = rows.withColumn("__v", F.when(F.col("__v") >= F.col("low"), F.col("__v"))).groupBy(*keys, "name", "rank", "n", "least", "most", "__v").count()
    order = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("count").over(order))
    hit = ranked.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("count") <= F.col("rank")))
    return written(hit.groupBy(*keys).agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("most").alias("most"), *(F.max(F.when(F.col("name") == x, F.col("__v"))).alias(x) for x in names)))


def positions(df: DataFrame, keys: list[str], order: str, name: str = "pos", partitions: int | None = None) -> DataFrame:
    """The rows with their position within their group, from 0. Ranges of (group, order) are counted apart and then offset, so one large group is spread over many tasks.

    The dealt rows are written once: counts and ranks must see the same ranges, and a second range exchange would draw other bounds.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part", *keys).count()
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(order)) - 1
    return dealt.withColumn("__local", local).join(offsets, ["__part", *keys]).withColumn(name, F.col("__local") + F.col("__offset")).drop("__part", "__local", "__offset")
