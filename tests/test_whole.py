"""Queries that take whole tables, against SQL and loops without any cut."""

import duckdb
import pytest
from pyspark.sql import functions as F

from starloom.operators import catalog, guards, tiling
from starloom.queries import QUERIES
from starloom.queries.shared import OBJ, SKY, sep_sql, wrap_sql
from starloom.queries.skyviews import index_sql

SF = "/root/testdata/sf0.001"


def duck(sf):
    con = duckdb.connect()
    for t in "nation customer supplier part".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(spark, name, text, sf=SF):
    df = QUERIES[name](spark, sf)
    q = duck(sf).execute(text)
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(q.fetchall(), key=str)


def test_categories_keep_all_members(spark):
    o = spark.range(2500).select(F.col("id").alias("ord"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("id"), F.lit("one").alias("category"))
    assert catalog.by_category(o).first()[:] == ("one", 2500, 0, "P0", 2499)
    r = catalog.category_members(o).agg(F.count("*"), F.max("place"), F.count_if(F.col("place") == F.col("ord") + 1)).first()
    assert r[:] == (2500, 2500, 2500)


def test_category_groups_of_large_tables(spark):
    same(spark, "category_groups", f"WITH {OBJ} SELECT category, count(*) AS n, min(ord) AS first_ord, arg_min(id, ord) AS first_id, max(ord) AS last_ord FROM obj GROUP BY category", "/root/testdata/sf0.1")


SEEN = (
    f"{SKY}, vw AS (SELECT id AS view_id, ra, dec, CAST(id % 5 + 1 AS DOUBLE) AS fov, CAST(id % 3 + 3 AS INTEGER) AS ord, 180e0 / pow(2e0, id % 3 + 3) AS ang FROM sky), st AS (SELECT *, CAST(ceil((fov / 2 + 2 * ang) / ang) AS BIGINT) AS rs, CAST(least(pow(2e0, ord), ceil((fov / 2 + 2 * ang) / cos(radians(dec)) / ang)) AS BIGINT) AS cs FROM vw), "
    f"gr AS (SELECT view_id, ord, ra, ang, cs, dec + unnest(range(-rs, rs + 1)) * ang AS td FROM st), g2 AS (SELECT view_id, ord, round({wrap_sql('ra + j * ang')}, 9) AS tr, round(td, 9) AS td FROM (SELECT *, unnest(range(-cs, cs + 1)) AS j FROM gr WHERE td BETWEEN -90 AND 90)), {index_sql('tr', 'td', 'pow(2, ord)', 'reference', 'g2', 'view_id, ord')}, vt AS (SELECT DISTINCT view_id, ord, pix FROM ix)"
)


@pytest.mark.parametrize(("name", "text"), [
    ("visible_tiles", "SELECT view_id, ord, pix FROM vt"),
    ("cache_misses", "SELECT DISTINCT ord, pix FROM vt WHERE NOT EXISTS (SELECT 1 FROM vt c WHERE c.ord = vt.ord AND c.pix = vt.pix AND c.view_id % 2 = 0)"),
    ("overlay_tiles", "SELECT survey, ord, count(*) AS n, CAST(sum(pix) AS BIGINT) AS sum_pix FROM (SELECT DISTINCT ord, pix FROM vt), (VALUES ('gaia-dr3'), ('dss2-color'), ('2mass-j'), ('wise-color'), ('panstarrs-dr1')) s(survey) GROUP BY survey, ord"),
])
def test_every_customer_is_a_view(spark, name, text):
    same(spark, name, f"WITH {SEEN} {text}")


def test_every_view_has_tiles(spark):
    assert QUERIES["visible_tiles"](spark, SF).select("view_id").distinct().count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_union_reads_whole_tables(spark):
    same(spark, "catalog_union", f"WITH {OBJ}, u AS (SELECT 0 AS list, category FROM obj UNION ALL SELECT 1, 'SUPPLIER' FROM supplier) SELECT list, category, count(*) AS n FROM u GROUP BY ALL")


def test_every_pair_of_objects_is_matched(spark):
    same(spark, "cross_match", f"WITH {SKY}, d AS (SELECT a.id AS lid, b.id AS rid, {sep_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS dist FROM sky a JOIN sky b ON abs(a.dec - b.dec) <= 2 AND a.id < b.id) SELECT lid, rid, round(dist, 6) AS dist FROM d WHERE dist <= 2", "/root/testdata/sf0.01")


def test_every_pair_in_a_tile_is_counted(spark):
    same(spark, "point_tile_join", f"WITH {SKY}, {index_sql('ra', 'dec', '8', 'standard', 'sky', 'id')} SELECT a.pix, count(*) AS pairs, min(a.id) AS least_a, max(b.id) AS most_b FROM ix a JOIN ix b ON a.pix = b.pix AND a.id < b.id GROUP BY a.pix", "/root/testdata/sf0.01")


def test_pairs_of_like_parity_are_matched(spark):
    assert {(r.lid % 2, r.rid % 2) for r in QUERIES["cross_match"](spark, "/root/testdata/sf0.1").select("lid", "rid").distinct().collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_names_come_before_coordinates(spark):
    o = spark.createDataFrame([(2, "M42", "Orion Nebula", 83.8, -5.4), (1, "NGC7", "The 10 20 Nebula", 7.0, 8.0), (3, "X", "orion again", 1.0, 1.0)], "ord int, id string, name string, ra double, dec double")
    t = spark.createDataFrame([(0, " m42 "), (1, "ORION"), (2, "10 20"), (3, "62.0, -37.0"), (4, "nothing"), (5, "  "), (6, None)], "k int, text string")
    r = {x.k: (x.ra, x.dec, x.error is not None) for x in catalog.resolve(t, o).collect()}
    assert r == {0: (83.8, -5.4, False), 1: (83.8, -5.4, False), 2: (7.0, 8.0, False), 3: (62.0, -37.0, False), 4: (None, None, True), 5: (None, None, False), 6: (None, None, False)}


def test_named_customers_are_found(spark):
    r = QUERIES["resolve_coords"](spark, "/root/testdata/sf0.01").where("id % 28 = 5").selectExpr("count_if(ra is not null)", "count_if(error is not null)").first()
    assert r[0] > 0 and r[1] > 0


def test_interpolation_guard(spark):
    names = ("nearest", "bilinear", "bicubic", "lanczos", "Nearest", "linear", None)
    assert spark.range(1).select(*(guards.is_interpolation(F.lit(x).cast("string")).alias(str(i)) for i, x in enumerate(names))).first()[:] == (True,) * 4 + (False,) * 3


@pytest.mark.parametrize("name", ["asinh_stretch_by_image", "stretches", "scaling_equalized", "histogram_by_image", "color_bars", "display_pipeline", "resample_bilinear", "tile_index_standard", "visible_tiles", "visible_centers", "cross_match", "tile_neighbours", "cone_clustered", "epoch_counters"])
def test_generated_code_compiles(spark, name):
    """Without the way back to interpretation, code that grows too large is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_unfolding_opens_few_shuffle_files(spark):
    """Each task that unfolds views opens a file for every partition of the shuffle behind it: tens of thousands of views go to one, and none is made by a single task from a file that one task reads."""
    views = spark.range(60_000).selectExpr("id AS view_id", "id % 360.0D AS ra", "id % 170 - 85.0D AS dec", "1.0D AS fov", "3 AS ord")
    plan = tiling.tiles_in_view(views)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(2)" in plan
    assert QUERIES["visible_centers"](spark, SF).count() == QUERIES["visible_centers"](spark, SF).distinct().count() > 0


def test_places_round_as_the_sql_does(spark):
    r = spark.range(1, 200_000).select((F.col("id") * 0.0017999).alias("x")).select(F.count_if(tiling._nine_places(F.col("x")) != F.round("x", 9))).first()
    assert r[0] == 0
    text = f"WITH {SEEN} SELECT DISTINCT ord, pix FROM vt"
    from starloom.queries.skyviews import views
    got = {tuple(x) for x in tiling.tiles_in_view(views(spark, "/root/testdata/sf0.01")).collect()}
    assert got == set(duck("/root/testdata/sf0.01").execute(text).fetchall())


@pytest.mark.parametrize("name", ["scaling_mtf_auto", "scaling_percentile", "stretches", "scaling_equalized", "scaling_zscale", "display_pipeline"])
def test_pixels_are_not_brought_together_by_image(spark, name):
    """Ranges go to the pixels: no join sorts an image's rows in one task, and none sends the pixels."""
    import re

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "25k")  # below the pixels' columns, above a row an image
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"SortMergeJoin \[image#\d+\], \[image#\d+\]", plan)
    assert not re.search(r"BuildLeft", plan)
