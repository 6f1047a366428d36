"""Epochs played as a stream, object by object: a cursor and a timer each, kept in Spark's state store.

An epoch's successor is known when it comes. Until then the cursor stands on the last epoch; if
none comes for `idle` of event time, the timer ends the object's round: played epochs stop there, blinking ones
go on to the first. The state of an object is three items, however long its sequence, and what has been
emitted and read is in the query's checkpoint, so a restart goes on where it was.

Rows of one object come in order of time from batch to batch; within a batch they are sorted. Rows behind
the watermark are dropped by Spark. Object ids may not be null (such rows are left out).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PLAY, BLINK = "play", "blink"
OUT = "object_id string, item long, prev_item long, next_item long, place long, last boolean"
#: The state store that keeps timers and large state; a setting of the session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Cursor(StatefulProcessor):
    """Per object: the first epoch, the one the cursor stands on, the one before it, and its place from 1."""

    def __init__(self, mode: str, idle_ms: int):
        if mode not in (PLAY, BLINK):
            raise ValueError(f"mode is {PLAY} or {BLINK}")
        self.mode, self.idle_ms = mode, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "first long, prev long, item long, place long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "item"], kind="stable")
        state = self.cursor.get() if self.cursor.exists() else None
        first, prev, item, place = state if state else (None, None, None, 0)
        out = []
        for now in batch["item"].tolist():
            if place:
                out.append((key[0], item, prev, now, place, False))
                prev, item, place = item, now, place + 1
            else:
                first, prev, item, place = now, now, now, 1
        self.cursor.update((first, prev, item, place))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch["ts"].iloc[-1].timestamp() * 1000) + self.idle_ms)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.cursor.exists():
            first, prev, item, place = self.cursor.get()
            out.append((key[0], item, prev, item if self.mode == PLAY else first, place, True))
            self.cursor.clear()
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["object_id", "item", "prev_item", "next_item", "place", "last"]).astype({"item": "int64", "prev_item": "int64", "next_item": "int64", "place": "int64", "last": "bool"})

    def close(self) -> None:
        pass


def played(epochs: DataFrame, mode: str = PLAY, idle: str = "1 day", late: str = "1 second") -> DataFrame:
    """epochs: a stream of object_id, ts, item (long). (object_id, item, prev_item, next_item, place, last), a row for each epoch once its successor has come or its object's round has ended."""
    stream = epochs.where("object_id IS NOT NULL AND ts IS NOT NULL").select(F.col("object_id").cast("string").alias("object_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("item").cast("long").alias("item")).withWatermark("ts", late)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return stream.groupBy("object_id").transformWithStateInPandas(statefulProcessor=Cursor(mode, idle_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def play_to(spark: SparkSession, epochs: DataFrame, path: str, checkpoint: str, mode: str = PLAY, idle: str = "1 day", late: str = "1 second") -> None:
    """Plays all there is and appends it to Parquet, each epoch once; called again with the same checkpoint it goes on."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = played(epochs, mode, idle, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
