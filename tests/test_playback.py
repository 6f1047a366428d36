"""Epochs played in several batches, with restarts, against windows over the whole."""

import datetime as dt
import random

from pyspark.sql import functions as F

from starloom.operators import epochs as E
from starloom.streaming.playback import BLINK, PLAY, play_to

SCHEMA = "object_id string, ts timestamp, item long"


def test_playback_equals_the_windows(spark, tmp_path):
    r, start = random.Random(1), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = sorted(({(k, start + dt.timedelta(hours=r.randrange(2000)), r.randrange(10**9)) for k in ["a", "b", "c", "single"] for _ in range(1 if k == "single" else 80)}), key=lambda x: x[1])
    (tmp_path / "in").mkdir()
    source = str(tmp_path / "in")
    epochs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    beat = [("beat", start + dt.timedelta(days=400 + k), k) for k in range(2)]  # time goes on, so the last rounds end
    steps = [rows[:60], rows[60:61], rows[61:200], rows[200:], beat[:1], beat[1:]]
    for mode in (PLAY, BLINK):
        out, checkpoint = str(tmp_path / f"{mode}_out"), str(tmp_path / f"{mode}_checkpoint")
        for k, part in enumerate(steps):
            if mode == PLAY:
                spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
                play_to(spark, epochs, out, checkpoint, mode, "200 days")  # each call is a restart from the checkpoint
            elif k == 0:
                play_to(spark, epochs, out, checkpoint, mode, "200 days")
        got = sorted(tuple(x) for x in spark.read.parquet(out).where("object_id <> 'beat'").select("object_id", "item", "prev_item", "next_item", "place").collect())
        table = spark.createDataFrame(rows, SCHEMA)
        want = E.neighbours(table, ["object_id"], "item", ["ts", "item"])
        if mode == BLINK:
            want = want.drop("next_item")
            want = E.blink(want, ["object_id"], "item", ["ts", "item"])
        want = E.counters(want, ["object_id"], ["ts", "item"])
        assert got == sorted(tuple(x) for x in want.select("object_id", "item", "prev_item", "next_item", F.col("place").cast("long")).collect())
