"""Queries on catalogs: search, dimensions, joins, epochs, ADQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coordtext as X
from ..functions import dates
from ..functions.stretch import js_round
from ..operators import catalog as K
from ..operators import epochs as E
from ..operators import guards as V
from ..operators import matching as M
from ..plans import adql
from ..session import shared_dir, spread
from ..streaming.replay import windowed
from .shared import EP, OBJ, SKY, epochs, objects, sep_sql, sky, table

r6 = lambda c: F.round(c, 6)
#: Texts that one task parses.
TEXTS = 20_000


def object_search(spark, sf_dir):
    return K.search(objects(spark, sf_dir), "1").select("ord", "id", "name", "category")


def object_lookup(spark, sf_dir):
    return K.lookup(objects(spark, sf_dir), " p17 ").select("ord", "id", "name")


def first_category(spark, sf_dir):
    t = objects(spark, sf_dir)
    return K.search(t, "p1").join(F.broadcast(t.agg(F.min("category").alias("category"))), "category", "left_semi").select("ord", "id", "category")


def category_groups(spark, sf_dir):
    return K.by_category(objects(spark, sf_dir)).select("category", "n", "first_ord", "first_id", "last_ord")


def category_members(spark, sf_dir):
    return K.category_members(objects(spark, sf_dir)).select("category", "place", "ord", "id")


def catalog_union(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("category"), F.lit(None).cast("string").alias("description"))
    u = K.union_catalogs([objects(spark, sf_dir), suppliers])
    return u.groupBy("list", "category").agg(F.count("*").alias("n"))


def band_dimension(spark, sf_dir):
    s = sky(spark, sf_dir).withColumn("band", F.element_at(F.array(*(F.lit(b) for b in "ugrizyx")), (F.col("id") % 7 + 1).cast("int")))
    return K.with_dimension(s.select("id", "band"), K.bands(spark), "band").select("id", "band", "wavelength", "color")


def overlay_sets(spark, sf_dir):
    """Customers as views with two overlays each: one is added (or there already), one removed, two are toggled; views that then have each overlay."""
    k = F.col("c_custkey")
    survey = lambda i: F.element_at(F.array(*(F.lit(x[0]) for x in K.SURVEYS)), (i % 5 + 1).cast("int"))
    of = lambda *places: table(spark, sf_dir, "customer").select(k.alias("view"), F.explode(F.array(*(survey(k + p) for p in places))).alias("survey"))
    keys = ("view", "survey")
    grown = K.add_overlay(of(0, 2), table(spark, sf_dir, "customer").select(k.alias("view"), survey(k * 2).alias("survey")), keys)
    less = K.remove_overlay(grown, of(0), keys)
    flipped = K.toggle(less, of(2, 3), keys)
    count = lambda step, t: t.groupBy("survey").agg(F.count("*").alias("n"), F.sum("view").alias("views")).select(F.lit(step).alias("step"), "survey", "n", "views")
    return count("added", grown).unionByName(count("removed", less)).unionByName(count("toggled", flipped))


def semi_anti(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rich = o.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(rich, "c_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit("semi").alias("kind"), "n", "keys")
    b = c.join(rich, "c_custkey", "left_anti").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit("anti").alias("kind"), "n", "keys")
    return a.unionByName(b)


def views(spark, sf_dir):
    sky(spark, sf_dir).withColumnsRenamed({"ra": "coord_ra", "dec": "coord_dec"}).createOrReplaceTempView("starloom_object")
    table(spark, sf_dir, "supplier").createOrReplaceTempView("starloom_supplier")
    table(spark, sf_dir, "nation").createOrReplaceTempView("starloom_nation")
    table(spark, sf_dir, "orders").createOrReplaceTempView("starloom_orders")
    return {"dp1.Object": "starloom_object", "supplier": "starloom_supplier", "nation": "starloom_nation", "orders": "starloom_orders"}


def cone_adql(spark, sf_dir):
    v = views(spark, sf_dir)
    q = adql.query(spark, adql.cone_adql(120.0, 10.0, 60_000.0, most=40), v)
    return q.select("id", r6("dist").alias("dist"))


def cone_search(spark, sf_dir):
    return M.cone_search(sky(spark, sf_dir), 200.0, -30.0, 72_000.0, "id", 50).select("id", r6("dist").alias("dist"))


def ran(text):
    return lambda spark, sf_dir: adql.query(spark, text, views(spark, sf_dir), None)


ADQL = {
    "adql_box": "SELECT id, mag FROM dp1.Object WHERE CONTAINS(POINT('ICRS', coord_ra, coord_dec), BOX('ICRS', 100.0, 0.0, 40.0, 30.0)) = 1",
    "adql_polygon": "SELECT id FROM dp1.Object WHERE CONTAINS(POINT('ICRS', coord_ra, coord_dec), POLYGON('ICRS', 10.0, -20.0, 80.0, -20.0, 45.0, 50.0)) = 1",
    "adql_outside": "SELECT count(*) AS n FROM dp1.Object WHERE CONTAINS(POINT('ICRS', coord_ra, coord_dec), CIRCLE('ICRS', 50.0, 0.0, 30.0)) = 0",
    "adql_group_having": "SELECT kind, count(*) AS n, max(mag) AS brightest FROM dp1.Object WHERE mag > 0 GROUP BY kind HAVING count(*) > 10",
    "adql_joins": "SELECT n.n_name AS nation, count(s.s_suppkey) AS suppliers, count(o.id) AS objects FROM nation AS n LEFT OUTER JOIN supplier AS s ON n.n_nationkey = s.s_nationkey FULL OUTER JOIN dp1.Object AS o ON s.s_suppkey = o.id GROUP BY n.n_name",
    "adql_set_ops": "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT n_nationkey AS k FROM nation) UNION ALL (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier)",
    "adql_subquery": "SELECT TOP 20 o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) AS a FROM orders) AND o_custkey IN (SELECT id FROM dp1.Object WHERE mag > 5000) ORDER BY o_totalprice DESC, o_orderkey",
    "adql_windows": "SELECT id, kind, rank() OVER (PARTITION BY kind ORDER BY mag DESC, id) AS place FROM dp1.Object",
}
ADQL_SQL = {
    "adql_box": f"WITH {SKY} SELECT id, mag FROM sky WHERE abs(dec) <= 15 AND least(((ra - 100) % 360e0 + 360e0) % 360e0, ((100 - ra) % 360e0 + 360e0) % 360e0) <= 20",
    "adql_polygon": f"WITH {SKY} SELECT id FROM sky WHERE (CASE WHEN false THEN 1 ELSE 0 END + CASE WHEN (-20 > dec) <> (50 > dec) AND ra < (45e0 - 80) * (dec + 20) / 70e0 + 80 THEN 1 ELSE 0 END + CASE WHEN (50 > dec) <> (-20 > dec) AND ra < (10e0 - 45) * (dec - 50) / -70e0 + 45 THEN 1 ELSE 0 END) % 2 = 1",
    "adql_outside": f"WITH {SKY} SELECT count(*) AS n FROM sky WHERE NOT {sep_sql('50e0', '0e0', 'ra', 'dec')} <= 30",
    "adql_group_having": f"WITH {SKY} SELECT kind, count(*) AS n, max(mag) AS brightest FROM sky WHERE mag > 0 GROUP BY kind HAVING count(*) > 10",
    "adql_joins": f"WITH {SKY} SELECT n.n_name AS nation, count(s.s_suppkey) AS suppliers, count(o.id) AS objects FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey FULL JOIN sky o ON s.s_suppkey = o.id GROUP BY n.n_name",
    "adql_set_ops": "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT n_nationkey FROM nation) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)",
    "adql_subquery": f"WITH {SKY} SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_custkey IN (SELECT id FROM sky WHERE mag > 5000) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "adql_windows": f"WITH {SKY} SELECT id, kind, rank() OVER (PARTITION BY kind ORDER BY mag DESC, id) AS place FROM sky",
}


def adql_async(spark, sf_dir):
    job = adql.query_async(spark, "SELECT kind, count(*) AS n FROM dp1.Object GROUP BY kind", shared_dir(spark), views(spark, sf_dir))
    return job.result()


def cross_match(spark, sf_dir):
    s = sky(spark, sf_dir)
    left = s.select(F.col("id").alias("lid"), "ra", "dec")
    right = s.select(F.col("id").alias("rid"), "ra", "dec")
    return M.cross_match(left, right, 2.0).where("lid < rid").select("lid", "rid", js_round(F.col("dist"), 6).alias("dist"))


def as_of_view(spark, sf_dir):
    e = epochs(spark, sf_dir)
    left = e.where("band = 'purchase'").select("object_id", "mjd", "event_id")
    right = e.where("band = 'view'").groupBy("object_id", "mjd").agg(F.max("magnitude").alias("seen"))
    return M.as_of(left, right, "object_id", "mjd", "seen", 7.0).select("event_id", "object_id", "seen")


ORDER = ["mjd", "event_id"]


def epoch_neighbours(spark, sf_dir):
    e = E.steps(epochs(spark, sf_dir), ["object_id"], "event_id", ORDER, 7.0)
    return e.select("event_id", "prev_item", F.col("next_item").alias("after"), F.col("blink_item").alias("blink_to"))


def epoch_counters(spark, sf_dir):
    return E.counters(epochs(spark, sf_dir), ["object_id"], ORDER, slice_width=7.0).select("event_id", F.col("place").cast("int").alias("place"), "total", "label", "is_shown", "more")


def epochs_generated(spark, sf_dir):
    """For every object as many made-up epochs as it has observations."""
    return E.generated_for(epochs(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("n")), "object_id", "n", 7)


def mjd_dates(spark, sf_dir):
    return epochs(spark, sf_dir).select("event_id", r6("mjd").alias("mjd"), dates.mjd_to_date(F.col("mjd")).cast("string").alias("iso_date"))


def light_curves(spark, sf_dir):
    s = E.light_curve_summary(epochs(spark, sf_dir))
    return s.select("object_id", "band", "n", r6("first_mjd").alias("first_mjd"), r6("last_mjd").alias("last_mjd"), "brightest", r6("mean_magnitude").alias("mean_magnitude"))


def rgb_composite(spark, sf_dir):
    e = epochs(spark, sf_dir).withColumnRenamed("magnitude", "value")
    c = E.composite(e, {"r": "click", "g": "view", "b": "purchase"})
    return c.select("object_id", *(r6(x).alias(x) for x in "rgb"))


def daily_windows(spark, sf_dir):
    w = windowed(table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6("mean").alias("mean"))


def tile_failures(spark, sf_dir):
    from ..operators.tiling import failure_alert

    a = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("host"), (F.col("l_quantity") > 25).alias("ok"))
    return failure_alert(a, ["host"])


def coords(mode):
    def run(spark, sf_dir):
        texts = spread(sky(spark, sf_dir).select("id", coord_text().alias("text")), TEXTS)
        p = X.parse(F.col("text"), mode)
        return texts.select("id", r6(p["ra"]).alias("ra"), r6(p["dec"]).alias("dec"), p["error"].alias("error"))

    return run


def coord_text():
    i = F.col("id")
    h, m, d = (i % 24).cast("string"), (i % 60).cast("string"), (i % 180 - 90).cast("string")
    shapes = [F.concat((i % 400).cast("string"), F.lit(".5, "), d), F.concat(h, F.lit("h"), m, F.lit("m12.5s "), d, F.lit("d"), m, F.lit("m30s")), F.concat(h, F.lit("h "), F.lit("30d")), F.concat(h, F.lit("h -0d30m")), F.concat(F.lit("  "), (i % 90).cast("string"), F.lit("e0 -"), (i % 120).cast("string")), F.lit("nothing"), F.lit(" ")]
    return F.element_at(F.array(*shapes), (i % 7 + 1).cast("int"))


COORD = "CASE id % 7 WHEN 0 THEN (id % 400) || '.5, ' || (id % 180 - 90) WHEN 1 THEN (id % 24) || 'h' || (id % 60) || 'm12.5s ' || (id % 180 - 90) || 'd' || (id % 60) || 'm30s' WHEN 2 THEN (id % 24) || 'h 30d' WHEN 3 THEN (id % 24) || 'h -0d30m' WHEN 4 THEN '  ' || (id % 90) || 'e0 -' || (id % 120) WHEN 5 THEN 'nothing' ELSE ' ' END"


def coords_sql(mode: str) -> str:
    ra, dec = (X.LENIENT_RA, X.LENIENT_DEC) if mode == "lenient" else (X.STRICT_RA, X.STRICT_DEC)
    error = (X.LENIENT_ERROR if mode == "lenient" else X.STRICT_ERROR).replace("'", "''")
    rest = f"CASE WHEN regexp_matches(q, '{ra}') THEN substr(q, length(regexp_extract(q, '{ra}', 0)) + 1) ELSE q END" if mode == "lenient" else "q"
    part = lambda c, p, k: f"coalesce(try_cast(regexp_extract({c}, '{p}', {k}) AS DOUBLE), 0e0)"
    return (
        f"WITH {SKY}, t AS (SELECT id, trim({COORD}) AS q FROM sky), s AS (SELECT id, q, list_filter(regexp_split_to_array(q, '[,\\s]+'), lambda x: length(x) > 0) AS p, {rest} AS rest FROM t), "
        f"n AS (SELECT *, CASE WHEN len(p) = 2 AND regexp_matches(p[1], '{X.NUMBER}') THEN try_cast(p[1] AS DOUBLE) END AS a, CASE WHEN len(p) = 2 AND regexp_matches(p[2], '{X.NUMBER}') THEN try_cast(p[2] AS DOUBLE) END AS b FROM s), "
        f"e AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AS pair, CASE WHEN NOT a BETWEEN 0 AND 360 THEN '{X.RA_ERROR}' WHEN NOT b BETWEEN -90 AND 90 THEN '{X.DEC_ERROR}' END AS err, regexp_matches(q, '{ra}') AND regexp_matches(rest, '{dec}') AS sx, ({part('q', ra, 1)} + {part('q', ra, 2)} / 60 + {part('q', ra, 3)} / 3600) * 15 AS sra, abs(try_cast(regexp_extract(rest, '{dec}', 1) AS DOUBLE)) + {part('rest', dec, 2)} / 60 + {part('rest', dec, 3)} / 3600 AS sd, starts_with(regexp_extract(rest, '{dec}', 1), '-') AS neg FROM n) "
        f"SELECT id, round(CASE WHEN q = '' THEN NULL WHEN pair AND err IS NULL THEN a WHEN NOT pair AND sx THEN sra END, 6) AS ra, round(CASE WHEN q = '' THEN NULL WHEN pair AND err IS NULL THEN b WHEN NOT pair AND sx THEN CASE WHEN neg THEN -sd ELSE sd END END, 6) AS dec, CASE WHEN q = '' THEN NULL WHEN pair THEN err WHEN NOT sx THEN '{error}' END AS error FROM e"
    )


def resolve_coords(spark, sf_dir):
    """nations as named objects; half of the texts that are no coordinates are names."""
    k = F.col("n_nationkey")
    named = table(spark, sf_dir, "nation").select(k.alias("ord"), F.concat(F.lit("N"), k.cast("string")).alias("id"), F.col("n_name").alias("name"), (k * 14.25).cast("double").alias("ra"), (k * 5.5 - 60).cast("double").alias("dec"))
    i = F.col("id")
    name = F.when(i % 28 == 5, F.concat(F.lit("  nation_"), (i % 30).cast("string"))).when(i % 28 == 12, F.concat(F.lit("n"), (i % 30).cast("string"), F.lit(" ")))
    r = K.resolve(spread(sky(spark, sf_dir).select("id", F.coalesce(name, coord_text()).alias("text")), TEXTS), named)
    return r.select("id", r6(F.col("ra")).alias("ra"), r6(F.col("dec")).alias("dec"), "error")


NAMED = f"CASE id % 28 WHEN 5 THEN '  nation_' || (id % 30) WHEN 12 THEN 'n' || (id % 30) || ' ' ELSE {COORD} END"


def resolve_sql() -> str:
    return (
        f"WITH {SKY}, c AS ({coords_sql('lenient').replace(COORD, NAMED)}), o AS (SELECT n_nationkey AS ord, 'n' || n_nationkey AS id, lower(n_name) AS name, n_nationkey * 14.25e0 AS ra, n_nationkey * 5.5e0 - 60 AS dec FROM nation), t AS (SELECT id, lower(trim({NAMED})) AS q FROM sky), "
        "f AS (SELECT t.id, arg_min(o.ra, o.ord) AS ra, arg_min(o.dec, o.ord) AS dec FROM t JOIN o ON q <> '' AND (o.id = q OR contains(o.name, q)) GROUP BY t.id) "
        "SELECT c.id, CASE WHEN f.id IS NULL THEN c.ra ELSE round(f.ra, 6) END AS ra, CASE WHEN f.id IS NULL THEN c.dec ELSE round(f.dec, 6) END AS dec, CASE WHEN f.id IS NULL THEN c.error END AS error FROM c LEFT JOIN f ON c.id = f.id"
    )


def coord_formats(spark, sf_dir):
    s = sky(spark, sf_dir)
    ra, dec = F.col("ra"), F.col("dec")
    return s.select("id", X.format_ra(ra).alias("ra"), X.format_dec(dec).alias("dec"), X.format_degrees(ra, "ra").alias("ra_plain"), X.format_degrees(dec, "dec").alias("dec_plain"), X.format_grid(ra, "ra").alias("ra_grid"), X.format_grid(dec, "dec").alias("dec_grid"), X.signed(dec, 4).alias("fixed"), X.format_magnitude(F.col("mag") / 1000).alias("mag"), X.format_scale(ra / 2).alias("scale"))


def fx(x: str, n: int) -> str:
    return f"(CAST(CAST(floor(({x}) * 1e{n} + 0.5e0) AS BIGINT) // {10**n} AS VARCHAR) || '.' || lpad(CAST(CAST(floor(({x}) * 1e{n} + 0.5e0) AS BIGINT) % {10**n} AS VARCHAR), {n}, '0'))"


def sg(x: str, n: int) -> str:
    return f"(CASE WHEN ({x}) < 0 AND floor(abs({x}) * 1e{n} + 0.5e0) > 0 THEN '-' ELSE '' END || {fx(f'abs({x})', n)})"


def pad(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) >= {n} THEN {x} ELSE lpad({x}, {n}, '0') END)"


def formats_sql() -> str:
    w = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
    m = lambda x: f"(({x} - floor({x})) * 60)"
    h, d = "(ra / 15)", "abs(dec)"
    s = lambda x: f"(({m(x)} - floor({m(x)})) * 60)"
    ps = lambda x: f"(({x} - floor({x})) * 3600 - floor({m(x)}) * 60)"
    sign = "CASE WHEN dec >= 0 THEN '+' ELSE '-' END"
    scale = f"CASE WHEN ra / 2 >= 60 THEN {fx('ra / 2 / 60', 1)} || '°' WHEN ra / 2 < 1 THEN {fx('ra / 2', 1)} || '''' ELSE CAST(CAST(floor(ra / 2 + 0.5e0) AS BIGINT) AS VARCHAR) || '''' END"
    return (
        f"WITH {SKY} SELECT id, {pad(w(h), 2)} || 'h' || {pad(w(m(h)), 2)} || 'm' || {pad(fx(s(h), 2), 5)} || 's' AS ra, {sign} || {pad(w(d), 2)} || 'd' || {pad(w(m(d)), 2)} || 'm' || {pad(fx(s(d), 1), 4)} || 's' AS dec, "
        f"{w(h)} || 'h ' || {w(m(h))} || 'm ' || {sg(ps(h), 2)} || 's' AS ra_plain, {sign} || {w(d)} || '° ' || {w(m(d))} || ''' ' || {sg(ps(d), 1)} || '\"' AS dec_plain, {w(h)} || 'h' || {pad(w(m(h)), 2)} || 'm' AS ra_grid, {sign} || {w(d)} || '°' || {pad(w(m(d)), 2)} || '''' AS dec_grid, {sg('dec', 4)} AS fixed, 'm' || {sg('mag / 1000', 1)} AS mag, {scale} AS scale FROM sky"
    )


def guard_counts(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    k = F.col("p_partkey") % 5
    name = F.element_at(F.array(*(F.lit(x) for x in ("Object", "object", "DiaSource", "Sky", "Source"))), (k + 1).cast("int"))
    method = F.element_at(F.array(*(F.lit(x) for x in ("asinh", "Asinh", "mtf", "none", "zscale"))), (k + 1).cast("int"))
    number = F.when(k == 1, "x").when(k == 2, F.lit(None)).otherwise("0.5")
    return t.groupBy(k.alias("k")).agg(F.count_if(V.is_catalog_name(name)).alias("catalogs"), F.count_if(V.is_scaling(method, number)).alias("scalings"), F.count_if(V.is_cone(F.col("p_retailprice"), F.col("p_retailprice"), F.lit(1.0), name)).alias("cones"))


QUERIES = {
    "object_search": object_search, "object_lookup": object_lookup, "first_category": first_category, "category_groups": category_groups, "category_members": category_members, "catalog_union": catalog_union, "band_dimension": band_dimension, "overlay_sets": overlay_sets, "semi_anti": semi_anti,
    "cone_adql": cone_adql, "cone_search": cone_search, **{k: ran(v) for k, v in ADQL.items()}, "adql_async": adql_async, "cross_match": cross_match, "as_of": as_of_view, "epoch_neighbours": epoch_neighbours, "epoch_counters": epoch_counters,
    "epochs_generated": epochs_generated, "mjd_dates": mjd_dates, "light_curves": light_curves, "rgb_composite": rgb_composite, "daily_windows": daily_windows, "tile_failures": tile_failures, "parse_coords_lenient": coords("lenient"), "parse_coords_strict": coords("strict"),
    "resolve_coords": resolve_coords, "coord_formats": coord_formats, "guard_counts": guard_counts,
}
SQL = {
    "object_search": f"WITH {OBJ} SELECT ord, id, name, category FROM obj WHERE contains(lower(id), '1') OR contains(lower(name), '1') OR contains(lower(coalesce(description, '')), '1')",
    "object_lookup": f"WITH {OBJ} SELECT ord, id, name FROM obj WHERE lower(id) = 'p17' OR contains(lower(name), 'p17') ORDER BY ord LIMIT 1",
    "first_category": f"WITH {OBJ} SELECT ord, id, category FROM obj WHERE category = (SELECT min(category) FROM obj) AND (contains(lower(id), 'p1') OR contains(lower(name), 'p1') OR contains(lower(coalesce(description, '')), 'p1'))",
    "category_groups": f"WITH {OBJ} SELECT category, count(*) AS n, min(ord) AS first_ord, arg_min(id, ord) AS first_id, max(ord) AS last_ord FROM obj GROUP BY category",
    "category_members": f"WITH {OBJ} SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY ord) AS INTEGER) AS place, ord, id FROM obj",
    "catalog_union": f"WITH {OBJ}, u AS (SELECT 0 AS list, category FROM obj UNION ALL SELECT 1, 'SUPPLIER' FROM supplier) SELECT list, category, count(*) AS n FROM u GROUP BY ALL",
    "band_dimension": f"WITH d(band, wavelength, color) AS (VALUES {', '.join(f'({b[0]!r}, {b[1]}, {b[2]!r})' for b in K.BANDS)}), s AS (SELECT c_custkey AS id, substr('ugrizyx', CAST(c_custkey % 7 + 1 AS BIGINT), 1) AS band FROM customer) SELECT id, s.band, wavelength, color FROM s LEFT JOIN d ON s.band = d.band",
    "overlay_sets": f"WITH d(i, survey) AS (VALUES {', '.join(f'({i}, {x[0]!r})' for i, x in enumerate(K.SURVEYS))}), c AS (SELECT c_custkey AS view FROM customer), a AS (SELECT view, (view + p) % 5 AS i FROM c, (VALUES (0), (2)) v(p) UNION SELECT view, view * 2 % 5 FROM c), r AS (SELECT * FROM a WHERE i <> view % 5), t AS (SELECT view, (view + p) % 5 AS i FROM c, (VALUES (2), (3)) v(p)), f AS ((SELECT * FROM r EXCEPT SELECT * FROM t) UNION ALL (SELECT * FROM t EXCEPT SELECT * FROM r)), u AS (SELECT 'added' AS step, * FROM a UNION ALL SELECT 'removed', * FROM r UNION ALL SELECT 'toggled', * FROM f) SELECT step, survey, count(*) AS n, CAST(sum(view) AS BIGINT) AS views FROM u JOIN d USING (i) GROUP BY step, survey",
    "semi_anti": "WITH r AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000) SELECT 'semi' AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey IN (SELECT k FROM r) UNION ALL SELECT 'anti', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT k FROM r)",
    "cone_adql": f"WITH {SKY}, d AS (SELECT id, {sep_sql('120e0', '10e0', 'ra', 'dec')} AS dist FROM sky) SELECT id, round(dist, 6) AS dist FROM d WHERE dist <= 60000e0 / 3600 ORDER BY d.dist LIMIT 40",
    "cone_search": f"WITH {SKY}, d AS (SELECT id, {sep_sql('200e0', '-30e0', 'ra', 'dec')} AS dist FROM sky) SELECT id, round(dist, 6) AS dist FROM d WHERE dist <= 20 ORDER BY d.dist, id LIMIT 50",
    **ADQL_SQL,
    "adql_async": f"WITH {SKY} SELECT kind, count(*) AS n FROM sky GROUP BY kind",
    "cross_match": f"WITH {SKY}, d AS (SELECT a.id AS lid, b.id AS rid, {sep_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS dist FROM sky a JOIN sky b ON abs(a.dec - b.dec) <= 2 AND a.id < b.id) SELECT lid, rid, round(dist, 6) AS dist FROM d WHERE dist <= 2",
    "as_of": f"WITH {EP}, l AS (SELECT * FROM ep WHERE band = 'purchase'), r AS (SELECT object_id, mjd, max(magnitude) AS seen FROM ep WHERE band = 'view' GROUP BY ALL) SELECT event_id, l.object_id, seen FROM l ASOF LEFT JOIN r ON l.object_id = r.object_id AND l.mjd >= r.mjd",
    "epoch_neighbours": f"WITH {EP} SELECT event_id, coalesce(lag(event_id) OVER w, event_id) AS prev_item, coalesce(lead(event_id) OVER w, event_id) AS after, coalesce(lead(event_id) OVER w, first(event_id) OVER w) AS blink_to FROM ep WINDOW w AS (PARTITION BY object_id ORDER BY mjd, event_id)",
    "epoch_counters": f"WITH {EP}, c AS (SELECT event_id, row_number() OVER (PARTITION BY object_id ORDER BY mjd, event_id) AS place, count(*) OVER (PARTITION BY object_id) AS total FROM ep) SELECT event_id, CAST(place AS INTEGER) AS place, total, place || ' / ' || total AS label, place <= 5 AS is_shown, greatest(total - 5, 0) AS more FROM c",
    "mjd_dates": f"WITH {EP} SELECT event_id, round(mjd, 6) AS mjd, CAST(DATE '1858-11-17' + CAST(floor(mjd) AS INTEGER) AS VARCHAR) AS iso_date FROM ep",
    "light_curves": f"WITH {EP} SELECT object_id, band, count(*) AS n, round(min(mjd), 6) AS first_mjd, round(max(mjd), 6) AS last_mjd, min(magnitude) AS brightest, round(avg(magnitude), 6) AS mean_magnitude FROM ep GROUP BY object_id, band",
    "rgb_composite": f"WITH {EP} SELECT object_id, round(avg(magnitude) FILTER (WHERE band = 'click'), 6) AS r, round(avg(magnitude) FILTER (WHERE band = 'view'), 6) AS g, round(avg(magnitude) FILTER (WHERE band = 'purchase'), 6) AS b FROM ep GROUP BY object_id",
    "daily_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "tile_failures": "SELECT l_suppkey % 50 AS host, count(*) AS attempts, count(*) FILTER (WHERE NOT l_quantity > 25) AS failures, count(*) FILTER (WHERE NOT l_quantity > 25) > 5 AND count(*) FILTER (WHERE NOT l_quantity > 25) / count(*) > 0.5e0 AS alert FROM lineitem GROUP BY 1",
    "parse_coords_lenient": coords_sql("lenient"),
    "parse_coords_strict": coords_sql("strict"),
    "resolve_coords": resolve_sql(),
    "coord_formats": formats_sql(),
    "guard_counts": "SELECT p_partkey % 5 AS k, count(*) FILTER (WHERE p_partkey % 5 IN (0, 2, 4)) AS catalogs, count(*) FILTER (WHERE p_partkey % 5 IN (0, 2, 4)) AS scalings, count(*) FILTER (WHERE p_partkey % 5 IN (0, 2, 4)) AS cones FROM part GROUP BY 1",
}
