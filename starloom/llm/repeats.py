"""What the exact repeat removers share: the document table they scan, and spans of removed text."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, splits, text_key

#: Columns that are added; the rest of the documents goes along untouched.
ADDED = ["__id", "__k", "__copy"]
_LAST = (1 << 63) - 1


def bucketed(df: DataFrame, n: int, column: str) -> DataFrame:
    """The frame as a table in the shared folder, dealt by the column, so that joins on it move only the other side."""
    spark = df.sparkSession
    name = f"starloom_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).format("parquet").option("compression", "zstd").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def prepared(docs: DataFrame, parts: int | None = None, groups: int = 0) -> tuple[DataFrame, int]:
    """The documents with __id (a null id sorts last), __k (key of the row: id and text) and __copy, bucketed by __k.

    groups: add __g too, one of so many groups of rows a partition, and bucket by it.

    __copy: a document with a smaller id has the same text. Only keys are grouped, so a text
    that a third of all rows repeat is one row per task; texts are shuffled once.
    """
    a, b = text_key()
    source = docs.withColumn("text", F.col("text").cast("string")).withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), "__a": a, "__b": b})
    source = source.withColumn("__k", F.xxhash64("__id", "__a", "__b"))
    parts = parts or splits(docs, "text")
    keys = source.select("__id", "__a", "__b", "__k")
    first = keys.groupBy("__a", "__b").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    copies = keys.join(first.drop("__last"), ["__a", "__b"]).where("__id > __first").select("__k", F.lit(True).alias("__copy")).distinct()
    whole = source.drop("__a", "__b").join(copies.hint("shuffle_hash"), "__k", "left").withColumn("__copy", F.coalesce("__copy", F.lit(False)))
    if groups:
        whole = whole.withColumn("__g", F.pmod(F.xxhash64("__k", F.lit(3)), F.lit(groups * parts)).cast("int"))
        return bucketed(whole.select(*docs.columns, *ADDED, "__g"), parts, "__g"), parts
    return bucketed(whole.select(*docs.columns, *ADDED), parts, "__k"), parts


def buckets(spark: SparkSession, parts: int) -> int:
    """How many buckets keys meet in: several for each task, so that what is frequent in one does not add up with others."""
    return 8 * max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_and_last(flags: np.ndarray, barrier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true flags as first and last places; barrier: places at which a run ends in any case."""
    flag = flags.view(np.int8)
    before = np.concatenate([[0], flag[:-1]])
    before[barrier[barrier < len(flag)]] = 0
    first = np.flatnonzero((flag == 1) & (before == 0))
    after = np.concatenate([flag[1:], [0]])
    stop = barrier[(barrier > 0) & (barrier <= len(flag))] - 1
    after[stop] = 0
    return first, np.flatnonzero((flag == 1) & (after == 0))


def covered(spans: list[tuple[int, int]], width: int, n: int) -> np.ndarray:
    """Mask of n places covered by windows of `width` that start in the given ranges (first, last)."""
    change = np.zeros(n + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[min(n, b + width)] -= 1
    return np.cumsum(change)[:-1] > 0
