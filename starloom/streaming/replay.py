"""Extension: epochs replayed as a stream, with windows and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and means by window and key; works on a stream (with a watermark) and on a table."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", size), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything there is, into a table in memory (for tests and small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def replay_to(stream: DataFrame, path: str, checkpoint: str):
    """Appends windows that can get no more rows to Parquet, exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
