"""Session settings and shipping of the package to executors."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "starloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; further settings as keywords with dots written as __."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver see.

    Where the setting is absent (tests on one machine) a folder below /tmp is taken; a
    cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame dealt into tasks of about so many rows, by the keys if there are any. A table of few bytes is read by one task, however much each row unfolds into."""
    return df.repartition(max(1, math.ceil(df.count() / rows)), *keys)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of written frames that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(), "starloom_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
