"""Tile files written and read by tasks; answers of different shapes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from starloom.sources import tap, tiles
from starloom.sources.tilestore import load_tiles, save_tiles


def files(root):
    return sorted(os.path.relpath(os.path.join(d, x), root) for d, _, names in os.walk(root) for x in names if not x.startswith("."))


def made(spark, n):
    return spark.range(n).select((F.col("id") % 3).cast("int").alias("ord"), (F.col("id") * 4000).alias("pix"), F.lit("png").alias("format"), F.encode(F.concat(F.lit("tile "), F.col("id").cast("string")), "utf-8").alias("content"))


def test_tiles_there_and_back(spark, tmp_path):
    root = str(tmp_path / "tiles")
    save_tiles(made(spark, 60), root)
    assert files(root) == sorted(f"Norder{i % 3}/Dir{i * 4000 // 10000 * 10000}/Npix{i * 4000}.png" for i in range(60))
    want = sorted((i % 3, i * 4000, "png", len(f"tile {i}"), f"tile {i}".encode()) for i in range(60))
    assert sorted((*r[:4], bytes(r[4])) for r in load_tiles(spark, root).collect()) == want
    assert sorted((*r[:4], bytes(r[4])) for r in tiles.read_tiles(spark, root).collect()) == want
    assert {r.ord for r in load_tiles(spark, root, 2).collect()} == {2}
    save_tiles(made(spark, 3).withColumn("content", F.lit(None).cast("binary")), root)  # replaced by empty files
    assert {r.pix: r.length for r in load_tiles(spark, root).collect() if r.length == 0} == {0: 0, 4000: 0, 8000: 0}
    assert load_tiles(spark, root).count() == 60
    assert load_tiles(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bad", ["raise_error", "index"])
def test_what_fails_leaves_no_file(spark, tmp_path, bad):
    root = str(tmp_path / "tiles")
    rows = made(spark, 60)
    if bad == "index":
        rows = rows.withColumn("pix", F.when(F.col("pix") == 200_000, -1).otherwise(F.col("pix")))
    else:
        rows = rows.withColumn("content", F.when(F.col("pix") == 200_000, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):  # noqa: B017
        save_tiles(rows, root)
    assert files(root) == []
    save_tiles(made(spark, 60), root)
    assert len(files(root)) == 60


def answers(tmp_path, *docs):
    folder = tmp_path / "answers"
    folder.mkdir()
    for i, d in enumerate(docs):
        (folder / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
    return str(folder)


def test_fields_of_all_files_count(spark, tmp_path):
    f = lambda **x: x
    path = answers(
        tmp_path,
        {"metadata": {"fields": [f(name="id", datatype="int"), f(ID="mag", datatype="float", unit="mag")]}, "data": [{"id": 1, "mag": 1.5}]},
        {"metadata": {"fields": [f(name="id", datatype="long", description="key"), f(name="late", datatype="boolean")]}, "rows": [{"id": 2**40, "late": True, "mag": "2.25"}]},
        {"data": [{"id": 3, "own": 1}, {"own": 2.5, "deep": {"a": [1, 2]}}]},
        {"metadata": {"fields": [f(name="both", datatype="int")]}, "data": [{"both": 1}]},
        {"metadata": {"fields": [f(name="both", datatype="char"), f()]}, "data": [{"both": "x", "unknown": "u"}]},
        {},
        "no json",
        {"metadata": None, "data": []},
    )
    r = tap.read_rows(spark, path)
    assert [(x.name, x.dataType.simpleString()) for x in r.schema][:6] == [("id", "bigint"), ("mag", "float"), ("late", "boolean"), ("both", "string"), ("unknown", "string"), ("deep", "struct<a:array<bigint>>")]
    assert r.schema["mag"].metadata == {"unit": "mag"} and r.schema["id"].metadata == {"description": "key"}
    got = {(x.id, x.mag, x.late, x.both, x.unknown, None if x.own is None else float(x.own), str(x.deep)) for x in r.collect()}
    assert got == {(1, 1.5, None, None, None, None, "None"), (2**40, 2.25, True, None, None, None, "None"), (3, None, None, None, None, 1.0, "None"), (None, None, None, None, None, 2.5, "Row(a=[1, 2])"), (None, None, None, "1", None, None, "None"), (None, None, None, "x", "u", None, "None")}


def test_no_answers(spark, tmp_path):
    assert tap.read_rows(spark, answers(tmp_path, {}, "x")).count() == 0


def test_many_answers_share_a_file(spark, tmp_path):
    """An answer a line, with other fields, rows under either name, none, or no answer at all."""
    from starloom.sources import tap

    lines = ['{"metadata": {"fields": [{"name": "k", "datatype": "int", "unit": "m"}]}, "data": [{"k": 1}, {"k": 2}]}', '{"metadata": {"fields": [{"name": "k", "datatype": "long", "unit": "km"}]}, "rows": [{"k": 3000000000, "more": "x"}]}', "{}", "no answer"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "a"))
    rows = tap.read_rows(spark, str(tmp_path / "a"), lines=True)
    assert sorted(map(tuple, rows.select("k", "more").collect()), key=str) == [(1, None), (2, None), (3000000000, "x")]
    assert rows.schema["k"].dataType.simpleString() == "bigint" and rows.schema["k"].metadata["unit"] == "km"


def test_answers_of_tap_shapes_take_no_file_each(spark):
    from starloom.queries import QUERIES

    assert len(QUERIES["tap_shapes"](spark, "/root/testdata/sf0.01").inputFiles()) < 25
