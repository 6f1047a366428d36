"""ADQL, readers, streaming, guards."""

import json

import pytest
from pyspark.sql import functions as F

from starloom.operators import guards as V
from starloom.plans import adql
from starloom.sources import tap, tiles
from starloom.streaming import replay


def test_adql_rewrites():
    assert adql.to_sql("SELECT TOP 5 a FROM s.t WHERE a > 1 ORDER BY a", {"s.t": "v"}) == "SELECT a FROM v WHERE a > 1 ORDER BY a LIMIT 5"
    assert "LIMIT 3" in adql.to_sql("SELECT DISTINCT TOP 3 x FROM t, u WHERE t.x = u.x")
    assert "`odd name`" in adql.to_sql('SELECT "odd name" FROM t')


@pytest.mark.parametrize("text", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT TOP x a FROM t", "SELECT a FROM t WHERE CONTAINS(POINT('ICRS', a, b), CIRCLE('ICRS', 1, 2)) = 1", "SELECT a FROM t WHERE CONTAINS(POINT('FK5', a, b), CIRCLE('ICRS', 1, 2, 3)) = 1", "SELECT ? FROM t"])
def test_adql_refuses(text):
    with pytest.raises(adql.AdqlError):
        adql.to_sql(text)


def test_cone_text():
    text = adql.cone_adql(62.0, -37.0, 36.0, "Object")
    assert "TOP 1000" in text and "0.01" in text
    with pytest.raises(adql.AdqlError):
        adql.cone_adql(1, 2, 3, "object; DROP TABLE x")


def test_async_job(spark, tmp_path):
    spark.range(7).createOrReplaceTempView("numbers_")
    job = adql.query_async(spark, "SELECT count(*) AS n FROM numbers_", str(tmp_path / "r"))
    assert job.result(60).first().n == 7 and job.phase == "COMPLETED"
    bad = adql.query_async(spark, "SELECT nothing FROM numbers_", str(tmp_path / "b"))
    with pytest.raises(Exception):  # noqa: B017
        bad.result(60)
    assert bad.phase == "ERROR"


def test_tap_json(spark, tmp_path):
    docs = [{"metadata": {"fields": [{"name": "a", "datatype": "int", "unit": "deg"}, {"ID": "b"}, {}]}, "data": [{"a": 1, "b": "x"}, {"a": 2}]}, {"rows": [{"a": "3"}]}, {}]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    r = {x.file[-6]: x for x in tap.read_json(spark, str(tmp_path)).collect()}
    assert [(c.name, c.datatype) for c in r["0"].columns] == [("a", "int"), ("b", "string"), ("unknown", "string")]
    assert [r[k].row_count for k in "012"] == [2, 1, 0] and r["1"].columns == []
    rows = tap.read_rows(spark, str(tmp_path / "0.json"))
    assert [x.a for x in rows.collect()] == [1, 2] and rows.schema["a"].metadata == {"unit": "deg"}
    raw = tap.read_raw(spark, str(tmp_path / "0.json")).collect()
    assert len(raw) == 1 and raw[0].row_count == 0


def test_properties(spark, tmp_path):
    (tmp_path / "a").write_text("# comment\nobs_title = Title = x\nhips_order=11\nhips_order = 12\nno sign\nhips_tile_format = png jpg\nhips_frame=equatorial\n")
    (tmp_path / "b").write_text("# nothing\n")
    (tmp_path / "c").write_text("creator_did = ivo://x\nhips_tile_width = 256\n")
    r = {x.file[-1]: x[1:] for x in tiles.read_properties(spark, str(tmp_path)).collect()}
    assert r == {"a": ("Title = x", 12, "png jpg", "equatorial", 512), "b": ("", 3, "png", "equatorial", 512), "c": ("ivo://x", 3, "png", "equatorial", 256)}
    empty = tiles.parse_properties(F.lit(""))
    assert spark.range(1).select(*empty.values()).first()[:] == ("", 3, "png", "equatorial", 512)


def test_tile_files(spark, tmp_path):
    p = tmp_path / "Norder3" / "Dir0"
    p.mkdir(parents=True)
    (p / "Npix42.png").write_bytes(b"abc")
    (p / "Npix43.txt").write_bytes(b"no")
    r = tiles.read_tiles(spark, str(tmp_path)).collect()
    assert [(x.ord, x.pix, x.format, bytes(x.content)) for x in r] == [(3, 42, "png", b"abc")]


def test_stream_replay(spark, tmp_path):
    t = spark.createDataFrame([("2024-01-01 10:00:00", "g", 1.0), ("2024-01-01 20:00:00", "g", 3.0), ("2024-01-02 01:00:00", "r", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    t.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = replay.windowed(replay.source(spark, str(tmp_path / "in"), t.schema))
    got = {(str(r.start)[:10], r.event_type, r.n, r["mean"]) for r in replay.run_once(stream, "replayed").collect()}
    assert got == {("2024-01-01", "g", 2, 2.0), ("2024-01-02", "r", 1, 5.0)}
    assert got == {(str(r.start)[:10], r.event_type, r.n, r["mean"]) for r in replay.windowed(t).collect()}


def test_guards(spark):
    lit = F.lit
    full = F.create_map(*(x for b in V.BANDS for x in (lit(b), lit(None).cast("double"))))
    r = spark.range(1).select(V.is_catalog_name(lit("Object")), V.is_catalog_name(lit("object")), V.is_photometry(full), V.is_photometry(F.create_map(lit("u"), lit(1.0))), V.is_tile(lit(1), lit(2), lit("u"), lit("gif")), V.is_epoch(lit(1.0), lit("2024")), V.is_scaling(lit("asinh"), lit("x"))).first()
    assert r[:] == (True, False, True, False, False, True, False)
