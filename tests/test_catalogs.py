"""Names in batches, tiles and cones, long sequences: against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from starloom.functions import cover
from starloom.functions.tileindex import order_for, surrounded, tile_index
from starloom.operators import catalog as K
from starloom.operators import epochs as E
from starloom.operators.matching import cone_search, cross_match
from starloom.operators.names import NameIndex
from starloom.operators.tiling import centers_of, missing_tiles, tile_centers, tiles_in_view, unloaded_tiles, visible_tiles
from starloom.sources.clustered import clustered_cone, rows_near, write_clustered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- names


@pytest.fixture(scope="module")
def objects(spark):
    r = random.Random(1)
    rows = [(i, f"M{i}", r.choice(["Crab Nebula", "crab", "Ring", "NGC", "Ångström é", "ab", "a", "", None]) if i % 3 == 0 else f"NGC {r.randrange(50)} {i % 7}", r.choice([None, "a cluster", "Galaxy"]), float(i), float(i % 90)) for i in range(400)]
    return spark.createDataFrame(rows, "ord int, id string, name string, description string, ra double, dec double")


TEXTS = ["m1", "M17", "crab", "CRAB NEB", "bula", "ngc 4", "ngc 41 3", "4", "c ", "é", "ström", "no such", "zzz", "", " ", None, " ring ", "m", "a", "ab", "abc", "galaxy", "cluster", "a c"]


def lookup(objects, text):
    t = text.strip().lower()
    return next((o.ord for o in objects if o.id.lower() == t or (o.name is not None and t in o.name.lower())), None)


@pytest.mark.parametrize(("q", "piece"), [(3, 50_000), (2, 7), (5, 1)])
def test_lookup_all(spark, objects, q, piece):
    rows = objects.collect()
    texts = spark.createDataFrame([(t,) for t in TEXTS] * 2, "text string")
    got = K.lookup_all(texts, objects, NameIndex.of(objects, q=q, piece=piece)).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert r.ord == (None if r.text is None else lookup(rows, r.text)), r


@pytest.mark.parametrize(("q", "piece"), [(3, 50_000), (2, 7)])
def test_search_all(spark, objects, q, piece):
    texts = spark.createDataFrame([(t,) for t in TEXTS] * 2, "text string")
    index = NameIndex.of(objects, ("id", "name", "description"), q, piece).stored()
    got = sorted((r.text, r.ord) for r in K.search_all(texts, objects, index).collect())
    want = sorted((t, o.ord) for t in TEXTS if t and t.strip() for o in objects.collect() if any(t.lower() in (x or "").lower() for x in (o.id, o.name, o.description)))
    assert got == want


def test_names_are_joined_by_equality(spark, objects):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for df in (K.lookup_all(texts, objects), K.search_all(texts, objects), K.resolve(texts, objects)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert K.lookup_all(texts.where("false"), objects).count() == 0
    assert {r.ord for r in K.lookup_all(texts, objects.where("false")).collect()} == {None}


def test_texts_are_not_broadcast(spark, objects):
    """Tables of texts and objects that look small in a shuffle would all go through the driver; only the list of very common grams does."""
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for df in (K.lookup_all(texts, objects), K.search_counts(texts, objects)):
        assert plan(df).count("BroadcastHashJoin") == 1


def test_long_texts_meet_few_objects(spark):
    """All names share their grams of three characters with hundreds of others."""
    names = spark.range(3000).selectExpr("id AS ord", "concat('M', id) AS id", "concat('large ring ', id) AS name")
    index = NameIndex.of(names)
    whole = names.select(F.col("name").alias("t"), F.explode(index.grams_for(F.col("name"))).alias("gram")).join(index.frequency, "gram").groupBy("t").agg(F.min("n").alias("n"))
    assert whole.agg(F.count("*"), F.max("n")).first()[:] == (3000, 1111)  # of "large ring 1" and the like
    assert whole.where("n > 111").count() <= 10


def test_search_counts(spark, objects):
    texts = spark.createDataFrame([(t,) for t in TEXTS] * 2, "text string")
    want = K.search_all(texts, objects).groupBy("text").agg(F.count("*").alias("n"), F.min("ord").alias("a"), F.max("ord").alias("b")).collect()
    assert sorted(map(tuple, K.search_counts(texts, objects).collect())) == sorted(map(tuple, want))


# -- tiles


def sphere(r, n):
    return [(i, r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(n)]


def around(ra, dec, distance, angle):
    d, t, p = math.radians(distance), math.radians(angle), math.radians(dec)
    z = math.asin(max(-1, min(1, math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(t))))
    return (ra + math.degrees(math.atan2(math.sin(t) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(z)))) % 360, math.degrees(z)


@pytest.mark.parametrize("order", [0, 1, 2, 5, 13])
def test_what_is_near_is_in_the_ring(spark, order):
    """Places within the ring's reach of another, most of them at poles, at the seam and where three base cells meet."""
    r, reach = random.Random(order), 0.6 * 58.6323 / (1 << order)
    hard = [(0.0, 90.0), (0.0, -90.0), (0.0, 0.0), (359.9999, 10.0), *((45.0 * k, s * 41.8103149) for k in range(8) for s in (-1, 1)), *((45.0 * k, 0.0) for k in range(8))]
    rows = []
    for k in range(3000):
        ra, dec = sphere(r, 1)[0][1:] if k % 2 else around(*r.choice(hard), r.uniform(0, 2 * reach), r.uniform(0, 360))
        rows.append((ra, dec, *around(ra, dec, r.uniform(0, reach * 0.999), r.uniform(0, 360))))
    n = F.lit(1 << order).cast("long")
    t = spark.createDataFrame(rows, "ra double, dec double, ra2 double, dec2 double")
    t = t.select("*", tile_index(F.col("ra"), F.col("dec"), n, "standard").alias("a"), tile_index(F.col("ra2"), F.col("dec2"), n, "standard").alias("b"))
    ring = surrounded(t, "a", 1 << order, "p")
    assert ring.where((F.col("p") < 0) | (F.col("p") >= 12 * n * n)).count() == 0
    assert ring.groupBy("ra", "dec", "ra2", "dec2").agg(F.max(F.col("p") == F.col("b")).alias("in")).where("NOT in").count() == 0


@pytest.mark.parametrize("n", [1, 2, 8])
def test_neighbours_are_mutual(spark, n):
    found = surrounded(spark.range(12 * n * n), "id", n, "b").collect()
    pairs = {(r.id, r.b) for r in found}
    assert len(pairs) == len(found)
    assert all((b, a) in pairs for a, b in pairs)
    if n > 1:
        size = [sum(a == k for a, _ in pairs) for k in range(12 * n * n)]
        assert set(size) == {8, 9} and size.count(8) == 24  # three base cells meet at eight places


@pytest.mark.parametrize("radius", [0.3, 3.0, 25.0, 60.0])
def test_cross_match(spark, radius):
    r = random.Random(7)
    rows = sphere(r, 150) + [(200 + i, *x) for i, x in enumerate([(0.0, 90.0), (123.0, 90.0), (10.0, -90.0), (0.0, 0.0), (360.0, 0.0), (359.95, 0.1), (0.05, -0.1), (90.0, 89.9), (270.0, 89.9), (180.0, -89.95), (45.0, 41.81), (44.9, 41.9), (44.9, 41.7)])]
    rows += [(300 + i, *around(ra, dec, r.uniform(0, radius * 1.2), r.uniform(0, 360))) for i, (_, ra, dec) in enumerate(rows[:60])]
    table = spark.createDataFrame([*rows, (999, None, 1.0)], "id int, ra double, dec double")
    got = sorted((x.lid, x.rid) for x in cross_match(table.withColumnRenamed("id", "lid"), table.withColumnRenamed("id", "rid"), radius).collect())
    close = [(a[0], b[0], cover.separation(a[1], a[2], b[1], b[2])) for a in rows for b in rows]
    assert got == sorted((a, b) for a, b, d in close if d <= radius)
    assert all(abs(d - radius) > 1e-9 for *_, d in close)


def test_orders():
    assert order_for(0.0) == 15 and order_for(35.0) == 0 and order_for(36.0) == -1


@pytest.mark.parametrize(("ra", "dec", "radius"), [(0, 90, 3), (10, -89, 20), (0, 0, 1), (359.9, 41.8, 0.5), (45, 41.81, 7), (200, -30, 40), (77, 12, 0.001), (0, 0, 180)])
def test_cover_holds_the_circle(spark, ra, dec, radius):
    r, order = random.Random(3), 13
    ranges = cover.cover(ra, dec, radius, order)
    rows = [around(ra, dec, radius * math.sqrt(r.random()) * 0.9999, r.uniform(0, 360)) for _ in range(2000)]
    pix = spark.createDataFrame(rows, "ra double, dec double").select(tile_index(F.col("ra"), F.col("dec"), F.lit(1 << order).cast("long"), "standard").alias("p"))
    for p in pix.collect():
        assert any(a <= p.p <= b for a, b in ranges)
    assert len(ranges) <= 64 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    share = sum(b - a + 1 for a, b in ranges) / (12 * 4**order)
    assert share <= max(1e-6, min(1, 2.5 * (1 - math.cos(math.radians(radius))) / 2))


def test_place_is_the_inverse_of_the_index(spark):
    rows = [(f, u, v, *cover.place(f, u / 64, v / 64)) for f in range(12) for u in range(1, 64, 3) for v in range(1, 64, 3)]
    n = 32
    t = spark.createDataFrame(rows, "f long, u long, v long, ra double, dec double").where("u % 2 = 1 and v % 2 = 1")
    from starloom.functions.tileindex import interleave

    want = F.col("f") * n * n + interleave(F.floor(F.col("u") / 2), F.floor(F.col("v") / 2))
    assert t.where(tile_index(F.col("ra"), F.col("dec"), F.lit(n).cast("long"), "standard") != want).count() == 0


def files_read(df):
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().get("numFiles").get().value()
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def test_cone_reads_the_files_it_meets(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, ra, dec) for i, ra, dec in sphere(r, 4000)] + [(5000 + i, 100.0, 20.0) for i in range(2000)] + [(9000, None, 1.0)]
    catalog = spark.createDataFrame(rows, "id int, ra double, dec double")
    path = str(tmp_path / "catalog")
    write_clustered(catalog, path, rows_per_file=100)
    total = len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert total > 40
    for ra, dec, radius in ((200.0, -30.0, 5.0), (0.0, 90.0, 8.0), (359.9, 1.0, 3.0), (100.0, 20.0, 0.5)):
        near = clustered_cone(spark, path, ra, dec, radius * 3600, "id", 10_000)
        assert near.columns == ["id", "ra", "dec", "dist"]
        assert [tuple(x) for x in near.collect()] == [tuple(x) for x in cone_search(catalog, ra, dec, radius * 3600, "id", 10_000).collect()]
    assert 1 <= files_read(rows_near(spark, path, 200.0, -30.0, 5.0)) <= total // 8
    assert files_read(rows_near(spark, path, 100.0, 20.0, 0.5)) >= 10  # two thousand rows at one place are many files
    write_clustered(catalog.where("false"), str(tmp_path / "none"))
    assert clustered_cone(spark, str(tmp_path / "none"), 1.0, 2.0, 3600.0, "id").count() == 0


# -- centres


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_centres_of_all_tiles(spark, order):
    tiles = spark.range(12 * 4**order).select(F.lit(order).alias("ord"), F.col("id").alias("pix"))
    got = {r.pix: (round(r.ra, 9), round(r.dec, 9)) for r in centers_of(tiles).collect()}
    want = {r.pix: (round(r.ra, 9), round(r.dec, 9)) for r in tile_centers(spark, order).collect()}
    assert got == {p: want.get(p, (0, 0)) for p in range(12 * 4**order)}


@pytest.mark.parametrize("order", [9, 13])
def test_centres_of_deep_tiles(spark, order):
    """The whole rows of the grid about a tile, searched in full."""
    side = 1 << order
    step = 45.0 / side
    n = F.lit(side).cast("long")
    places = spark.createDataFrame([(0.0, 90.0), (200.0, 89.99), (10.0, -89.995), (123.456, 41.8), (300.0, -41.82), (77.0, 5.0), (359.99, -20.0)], "ra double, dec double")
    tiles = places.select(F.lit(order).alias("ord"), tile_index(F.col("ra"), F.col("dec"), n).alias("pix"), F.col("dec").alias("d0")).collect()
    got = {r.pix: (r.ra, r.dec) for r in centers_of(spark.createDataFrame([(t.ord, t.pix) for t in tiles], "ord int, pix long").distinct()).collect()}
    for t in tiles:
        middle = round((t.d0 + 90) / step)
        near = [i for i in range(middle - 12, middle + 13) if 0 <= i <= 4 * side]
        rows = spark.createDataFrame([(i,) for i in near], "i int").select((F.col("i") * step - 90).alias("dec"))
        stride = step / F.least(F.lit(1.0), F.abs(F.cos(F.radians("dec"))) + 0.1)
        grid = rows.withColumn("stride", stride).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(360.0) / F.col("stride")).cast("int")))).withColumn("ra", F.col("k") * F.col("stride")).where("ra < 360")
        hit = grid.where(tile_index(F.col("ra"), F.col("dec"), n) == t.pix)
        best = hit.orderBy(F.col("dec") * F.col("dec") + F.least(F.col("ra"), 360 - F.col("ra")) * 0.1, "dec", "ra").first()
        assert got[t.pix] == pytest.approx((best.ra, best.dec), abs=1e-9)


# -- sequences


@pytest.fixture(scope="module")
def history(spark):
    r = random.Random(6)
    rows = [("hot", float(r.randrange(3000)) / 10, i, r.choice([None, i])) for i in range(3000)]
    rows += [(k, r.choice([None, float("nan"), float("inf"), -float("inf"), r.uniform(-9, 9)]), 5000 + i, i) for i, k in enumerate(["a", "b", "b", None, None, None, "c", "c", "c", "c"] * 6)]
    return spark.createDataFrame(rows, "object string, mjd double, n int, item int")


@pytest.mark.parametrize("width", [0.7, 7.0, 1e6])
def test_slices_change_nothing(history, width):
    order = ["mjd", "n"]
    for run in (E.neighbours, E.blink):
        assert sorted(map(repr, run(history, ["object"], "item", order, width).collect())) == sorted(map(repr, run(history, ["object"], "item", order).collect()))
    assert sorted(map(repr, E.counters(history, ["object"], order, slice_width=width).collect())) == sorted(map(repr, E.counters(history, ["object"], order).collect()))


def test_neighbours_in_plain_loops(history):
    by = {}
    for r in history.collect():
        by.setdefault(r.object, []).append(r)
    key = lambda r: (r.mjd is not None, math.isnan(r.mjd) if r.mjd is not None else False, r.mjd if r.mjd is not None and not math.isnan(r.mjd) else 0, r.n)
    want = {}
    for rows in by.values():
        rows.sort(key=key)
        for i, r in enumerate(rows):
            want[r.n] = (rows[max(0, i - 1)].item, rows[min(len(rows) - 1, i + 1)].item, rows[(i + 1) % len(rows)].item, i + 1, len(rows))
    got = E.neighbours(history, ["object"], "item", ["mjd", "n"], 5.0).withColumnRenamed("next_item", "after")
    got = E.blink(got, ["object"], "item", ["mjd", "n"], 5.0)
    got = E.counters(got, ["object"], ["mjd", "n"], slice_width=5.0)
    assert {r.n: (r.prev_item, r.after, r.next_item, r.place, r.total) for r in got.collect()} == want


def test_one_object_is_many_tasks(spark, history):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = E.neighbours(history.where("object = 'hot'"), ["object"], "item", ["mjd", "n"], 5.0)
        sizes = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1800


# -- views


@pytest.fixture(scope="module")
def views(spark):
    """Ids repeat at other places."""
    return spark.range(12_000).coalesce(1).selectExpr("id % 9000 AS view_id", "id * 137.5 % 360 AS ra", "id * 0.7 % 178 - 89 AS dec", "1.0D + id % 3 AS fov", "cast(id % 3 + 3 AS int) AS ord")


def test_tiles_of_views_are_distinct_without_a_shuffle(views):
    tiles = visible_tiles(views)
    assert tiles.count() == tiles.dropDuplicates().count()
    assert plan(tiles).count("Exchange hashpartitioning") == 1  # of the views
    assert tiles.rdd.getNumPartitions() == 3


def test_tiles_of_all_views(views):
    tiles = visible_tiles(views)
    want = {tuple(r) for r in tiles.select("ord", "pix").distinct().collect()}
    got = [tuple(r) for r in tiles_in_view(views).collect()]
    assert len(got) == len(want) and set(got) == want
    even = tiles.where("view_id % 2 = 0").select("ord", "pix").distinct()
    some = F.col("view_id") % 40 == 0
    for loaded, cached in ((F.col("view_id") % 2 == 0, even), (some, tiles.where(some).select("ord", "pix").distinct()), (F.lit(None).cast("boolean"), even.where("false"))):
        rows = [tuple(r) for r in unloaded_tiles(views, loaded).collect()]
        assert sorted(rows) == sorted(map(tuple, missing_tiles(tiles.select("ord", "pix").distinct(), cached).collect()))


def test_centers_are_searched_by_many_tasks(spark):
    tiles = spark.range(3500).coalesce(1).selectExpr("6 AS ord", "id AS pix")
    found = centers_of(tiles)
    assert found.count() == 3500 and found.rdd.getNumPartitions() == 4


def test_pairs_are_made_by_many_tasks_without_a_broadcast(spark):
    t = spark.range(12_000).coalesce(1).selectExpr("id", "id * 137.5 % 360 AS ra", "id * 0.7 % 178 - 89 AS dec")
    pairs = cross_match(t.withColumnRenamed("id", "lid"), t.withColumnRenamed("id", "rid"), 0.5)
    assert "BroadcastHashJoin" not in plan(pairs) and plan(pairs).count("REPARTITION_BY_NUM") == 4  # rows, then pairs of each side


@pytest.mark.parametrize("name", ["parse_coords_strict", "parse_coords_lenient"])
def test_texts_are_parsed_by_many_tasks(spark, name, monkeypatch):
    from starloom.queries import QUERIES, relations

    monkeypatch.setattr(relations, "TEXTS", 500)
    assert QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 3


def test_names_are_parsed_from_many_tasks(spark, monkeypatch):
    from starloom.queries import QUERIES, relations

    monkeypatch.setattr(relations, "TEXTS", 500)
    assert "REPARTITION_BY_NUM" in plan(QUERIES["resolve_coords"](spark, "/root/testdata/sf0.01"))


def test_images_are_resampled_by_many_tasks(spark):
    from starloom.operators.resample import resample

    t = spark.range(2000).coalesce(1).selectExpr("id", "2 AS w", "1 AS h", "array(0.0D, 1.0D) AS data")
    assert resample(t, 10, 10, "lanczos").rdd.getNumPartitions() == 4
