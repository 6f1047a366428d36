"""Queries on pixels: stretches, ranges, histograms, colours, resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import stretch as S
from ..operators import histogram as H
from ..operators import hooks, resample
from ..operators.epochs import median_stack
from ..operators.scaling import Scaling, apply_scaling, clean, display_range, zscale_range
from ..operators.scaling import flag_counts as flag_counts_of
from ..operators.scaling import flag_lists as flag_lists_of
from .shared import NX, PX, RG, channel_sql, packed, pixels, table

r6 = lambda c: F.round(c, 6)


def asinh_stretch_by_image(spark, sf_dir):
    """Flagship: range by image, asinh, viridis, summary."""
    rgb = C.color(F.col("scaled"), "viridis")
    colored = apply_scaling(pixels(spark, sf_dir), Scaling("asinh")).withColumn("c", rgb)
    return colored.groupBy("image").agg(F.count("*").alias("n"), r6(F.avg("scaled")).alias("mean_scaled"), F.sum("c.r").alias("sum_r"), F.sum("c.g").alias("sum_g"), F.sum("c.b").alias("sum_b"))


ASINH = f"asinh(x / 0.1e0) / {math.asinh(10)!r}e0"


def stretches(spark, sf_dir):
    rows = clean(pixels(spark, sf_dir), "image", "idx", "value")
    x = F.col("x")
    out = rows.join(display_range(rows), "image").withColumn("x", S.normalize(F.col("v"), F.col("low"), F.col("high")))
    return out.select("image", "idx", r6(S.linear(x)).alias("linear"), r6(S.log(x)).alias("log"), r6(S.sqrt(x)).alias("sqrt"), r6(S.asinh(x)).alias("asinh"), r6(S.sinh(x)).alias("sinh"), r6(S.mtf(x, 0.3)).alias("mtf"))


def scaling_overrides(spark, sf_dir):
    s = apply_scaling(pixels(spark, sf_dir), Scaling("linear", low=50_000.0, high=300_000.0))
    return s.select("image", "idx", r6("scaled").alias("scaled"), "is_underflow", "is_overflow")


def flag_counts(spark, sf_dir):
    return flag_counts_of(apply_scaling(pixels(spark, sf_dir), Scaling("percentile", low_percentile=10, high_percentile=90)))


def scaling_percentile(spark, sf_dir):
    s = apply_scaling(pixels(spark, sf_dir), Scaling("percentile", low_percentile=10, high_percentile=90))
    return s.select("image", "idx", r6("low").alias("low"), r6("high").alias("high"), r6("scaled").alias("scaled"), "is_underflow", "is_overflow")


def scaling_equalized(spark, sf_dir):
    return apply_scaling(pixels(spark, sf_dir), Scaling("histogram")).select("image", "idx", r6("scaled").alias("scaled"))


def scaling_mtf_auto(spark, sf_dir):
    return apply_scaling(pixels(spark, sf_dir), Scaling("mtf")).select("image", "idx", r6("scaled").alias("scaled"))


def whole(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.unionByName(p.withColumn("image", F.lit("whole")))


def zscale(spark, sf_dir):
    rows = clean(whole(spark, sf_dir), "image", "idx", "value")
    return zscale_range(rows).select("image", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


def scaling_zscale(spark, sf_dir):
    s = apply_scaling(pixels(spark, sf_dir), Scaling("zscale"))
    return s.groupBy("image").agg(F.round(F.avg("scaled"), 5).alias("mean_scaled"), F.count_if("is_overflow").alias("n_over"))


def zscale_ctes(whole: bool) -> str:
    ctes = [PX, f"p2 AS (SELECT image, idx, v FROM px{" UNION ALL SELECT 'whole', idx, v FROM px" if whole else ""})", "pos AS (SELECT image, v, row_number() OVER (PARTITION BY image ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY image) AS n FROM p2 WHERE v > 0)"]
    ctes.append("big AS (SELECT image, n, unnest(range(10000)) AS k FROM (SELECT DISTINCT image, n FROM pos WHERE n > 10000))")
    ctes.append("smp AS (SELECT image, v FROM pos WHERE n <= 10000 UNION ALL SELECT pos.image, pos.v FROM big JOIN pos ON pos.image = big.image AND pos.r = (big.k * big.n) // 10000)")
    ctes.append("rk AS (SELECT image, v, row_number() OVER (PARTITION BY image ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY image) AS n FROM smp)")
    ctes.append("a0 AS (SELECT image, v, i, n, CAST(i - n // 2 AS DOUBLE) AS x, true AS m FROM rk)")
    for k in range(5):
        ctes.append(f"f{k} AS (SELECT image, regr_slope(v, x) FILTER (WHERE m) AS s, regr_intercept(v, x) FILTER (WHERE m) AS b, count(*) FILTER (WHERE m) AS c FROM a{k} GROUP BY image)")
        ctes.append(f"g{k} AS (SELECT a.*, s, c, v - (b + s * x) AS e FROM a{k} a JOIN f{k} USING (image))")
        ctes.append(f"h{k} AS (SELECT image, sqrt(sum(e * e) FILTER (WHERE m) / (any_value(c) - 1)) AS sg FROM g{k} GROUP BY image)")
        ctes.append(f"a{k + 1} AS (SELECT g.image, v, i, n, x, CASE WHEN sg < 1e-30 THEN m ELSE m AND NOT abs(e) > 2.5e0 * sg END AS m FROM g{k} g JOIN h{k} USING (image))")
    ctes.append("z AS (SELECT image, min(v) AS lo, max(v) AS hi, max(n) AS n, count(*) FILTER (WHERE m) AS c, max(v) FILTER (WHERE i = n // 2) AS med FROM a5 GROUP BY image)")
    z1, z2 = "med + s / 0.25e0 * (1 - n // 2)", "med + s / 0.25e0 * (n - n // 2)"
    ctes.append(f"zr AS (SELECT image, CASE WHEN n < 3 OR c < n / 2 THEN lo ELSE greatest(lo, least({z1}, {z2})) END AS low, CASE WHEN n < 3 OR c < n / 2 THEN hi ELSE least(hi, greatest({z1}, {z2})) END AS high FROM z JOIN (SELECT image, s FROM f4) USING (image))")
    return "WITH " + ", ".join(ctes)


def histogram_fixed(spark, sf_dir):
    h = H.histogram(pixels(spark, sf_dir), "value", 1000.0, 401000.0, 16, ["image"])
    b = H.bar_heights(h, ["image"], (26000.0, 201000.0))
    return b.select("image", "bin", r6("x0").alias("x0"), r6("x1").alias("x1"), "n", r6("height").alias("height"), "in_range")


def histogram_by_image(spark, sf_dir):
    """Twenty bars an image between its own least and largest value."""
    p = pixels(spark, sf_dir)
    h = H.histogram_by(p, "value", p.groupBy("image").agg(F.min("value").alias("low"), F.max("value").alias("high")), ["image"], 20)
    return H.bar_heights(h, ["image"]).select("image", "bin", r6("x0").alias("x0"), r6("x1").alias("x1"), "n", r6("height").alias("height"))


def flag_lists(spark, sf_dir):
    """The pixels outside the 1 % to 99 % range of each image, as lists."""
    f = flag_lists_of(apply_scaling(pixels(spark, sf_dir), Scaling("percentile", low_percentile=1, high_percentile=99)))
    return f.select("image", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("underflow", "overflow")))


def histogram_handles(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    low, high = H.move_handle(F.col("d"), F.col("t"), "low"), H.move_handle(F.col("d"), F.col("t"), "high")
    return t.groupBy(low.alias("low"), high.alias("high")).count().select("low", "high", r6(H.handle_percent(F.col("low"), F.lit(0.0), F.lit(0.1))).alias("low_percent"), r6(H.handle_percent(F.col("high"), F.lit(0.0), F.lit(0.1))).alias("high_percent"), F.col("count").alias("n"))


def color_bars(spark, sf_dir):
    """The entries of all colour bars that the orders' prices fall on, and how many do; the maps are a table of nine rows."""
    i = F.floor(F.col("value") % 256).cast("int")
    used = pixels(spark, sf_dir).groupBy(i.alias("i")).agg(F.count("*").alias("n"))
    maps = C.stop_table(spark).select("map", F.struct("t", "r", "g", "b").alias("stops"))
    every = used.withColumn("map", F.explode(F.array(*map(F.lit, C.STOPS)))).join(F.broadcast(maps), "map")
    return every.select("map", "i", "n", C.color_of(F.col("i") / 255.0, "stops").alias("c")).select("map", "i", "c.r", "c.g", "c.b", "c.a", "n")


def color_bars_sql() -> str:
    one = lambda name: f"SELECT '{name}' AS map, i, {channel_sql('t', name, 1)} AS r, {channel_sql('t', name, 2)} AS g, {channel_sql('t', name, 3)} AS b, 255 AS a, n FROM b"
    return "WITH u AS (SELECT CAST(floor(o_totalprice % 256) AS INTEGER) AS i, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT i, n, i / 255e0 AS t FROM u) " + " UNION ALL ".join(map(one, C.STOPS))


def luma_invert(spark, sf_dir):
    e = packed(spark, sf_dir).select("vec_id", *(F.floor(F.abs(F.col("data")[k]) * 255 % 256).cast("int").alias(c) for k, c in enumerate("rgb")))
    return e.select("vec_id", r6(C.luma(F.col("r"), F.col("g"), F.col("b"))).alias("luma"), *(C.invert(F.col(c)).alias(f"inv_{c}") for c in "rgb"))


def alpha_composite(spark, sf_dir):
    layers = F.array(*(F.struct(F.col("data")[k].alias("value"), F.lit(20.0 * k).alias("opacity")) for k in (1, 2, 3)))
    return packed(spark, sf_dir).select("vec_id", r6(C.over_array(F.col("data")[0], layers)).alias("value"))


def resampled(method):
    def run(spark, sf_dir):
        out = resample.resample(packed(spark, sf_dir), 5, 11, method)
        return out.select("vec_id", F.posexplode("resampled").alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))

    return run


def resampled_sql(method: str) -> str:
    base = "WITH im AS (SELECT vec_id, embedding AS d FROM embeddings), g AS (SELECT vec_id, d, CAST(k AS INTEGER) AS k, (k % 5 + 0.5e0) * (8 / 5e0) - 0.5e0 AS x, (k // 5 + 0.5e0) * (8 / 11e0) - 0.5e0 AS y FROM im, range(55) t(k))"
    tap = lambda i, j: f"CAST(d[CAST(greatest(0, least(7, {j})) * 8 + greatest(0, least(7, {i})) AS BIGINT) + 1] AS DOUBLE)"
    if method == "nearest":
        return base + f" SELECT vec_id, k, round({tap('floor(x + 0.5e0)', 'floor(y + 0.5e0)')}, 6) AS v FROM g"
    if method == "bilinear":
        a = f"({tap('floor(x)', 'floor(y)')} * (1 - (x - floor(x))) + {tap('floor(x) + 1', 'floor(y)')} * (x - floor(x)))"
        b = f"({tap('floor(x)', 'floor(y) + 1')} * (1 - (x - floor(x))) + {tap('floor(x) + 1', 'floor(y) + 1')} * (x - floor(x)))"
        return base + f" SELECT vec_id, k, round({a} * (1 - (y - floor(y))) + {b} * (y - floor(y)), 6) AS v FROM g"
    cubic = lambda u: f"(CASE WHEN {u} <= 1 THEN 1.5e0 * {u} * {u} * {u} - 2.5e0 * {u} * {u} + 1 WHEN {u} < 2 THEN -0.5e0 * {u} * {u} * {u} + 2.5e0 * {u} * {u} - 4e0 * {u} + 2 ELSE 0e0 END)"
    lanczos = lambda u: f"(CASE WHEN {u} = 0 THEN 1e0 WHEN {u} >= 3 THEN 0e0 ELSE sin(pi() * {u}) / (pi() * {u}) * sin(pi() * {u} / 3) / (pi() * {u} / 3) END)"
    weight, low, high = (cubic, -1, 3) if method == "bicubic" else (lanczos, -2, 4)
    taps = f", tp AS (SELECT vec_id, k, d, floor(x) + i AS px, floor(y) + j AS py, abs(x - (floor(x) + i)) AS ux, abs(y - (floor(y) + j)) AS uy FROM g, range({low}, {high}) a(i), range({low}, {high}) b(j)), w AS (SELECT vec_id, k, {tap('px', 'py')} AS p, {weight('ux')} * {weight('uy')} AS wt FROM tp)"
    value = "sum(p * wt)" if method == "bicubic" else "CASE WHEN sum(wt) = 0 THEN 0e0 ELSE sum(p * wt) / sum(wt) END"
    return base + taps + f" SELECT vec_id, k, round({value}, 6) AS v FROM w GROUP BY vec_id, k"


def stacked(spark, sf_dir):
    return median_stack(packed(spark, sf_dir)).select("label", "idx", r6("median").alias("median"), "n")


def doubled(data, w, h, factor):
    return data.reshape(h, w).repeat(factor, axis=0).repeat(factor, axis=1).ravel()


def hook_upscale(spark, sf_dir):
    hooks.register("double", doubled)
    out = hooks.apply(packed(spark, sf_dir), "double", 2)
    return out.select("vec_id", F.size("upscaled").cast("long").alias("n"), r6(F.aggregate("upscaled", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def display_pipeline(spark, sf_dir):
    from ..operators.display import display

    v, i = F.floor("value").cast("int"), F.col("idx").cast("int")
    rgb = pixels(spark, sf_dir).select("image", "idx", (v % 256).alias("r"), (i % 256).alias("g"), (i * 7 % 256).alias("b"))
    return display(rgb, Scaling("sqrt"), "hot", inverted=True)


QUERIES = {
    "asinh_stretch_by_image": asinh_stretch_by_image, "stretches": stretches, "scaling_overrides": scaling_overrides, "scaling_percentile": scaling_percentile, "flag_counts": flag_counts, "scaling_equalized": scaling_equalized, "scaling_mtf_auto": scaling_mtf_auto,
    "zscale_range": zscale, "scaling_zscale": scaling_zscale, "histogram_fixed": histogram_fixed, "histogram_handles": histogram_handles, "histogram_by_image": histogram_by_image, "flag_lists": flag_lists, "color_bars": color_bars, "luma_invert": luma_invert, "alpha_composite": alpha_composite,
    **{f"resample_{m}": resampled(m) for m in resample.METHODS}, "median_stack": stacked, "display_pipeline": display_pipeline, "hook_upscale": hook_upscale,
}

PCT = "pr AS (SELECT image, list_sort(list(v))[CAST(floor(0.1e0 * (count(*) - 1)) AS BIGINT) + 1] AS low, list_sort(list(v))[CAST(floor(0.9e0 * (count(*) - 1)) AS BIGINT) + 1] AS high FROM px GROUP BY image)"
MTF = lambda x, m: f"CASE WHEN {x} <= 0 THEN 0e0 WHEN {x} >= 1 THEN 1e0 WHEN abs({m} - 0.5e0) < 0.001e0 THEN {x} ELSE (({m} - 1) * {x}) / ((2 * {m} - 1) * {x} - {m}) END"
SQL = {
    "asinh_stretch_by_image": f"WITH {PX}, {RG}, {NX}, s AS (SELECT image, {ASINH} AS t FROM nx) SELECT image, count(*) AS n, round(avg(t), 6) AS mean_scaled, CAST(sum({channel_sql('t', 'viridis', 1)}) AS BIGINT) AS sum_r, CAST(sum({channel_sql('t', 'viridis', 2)}) AS BIGINT) AS sum_g, CAST(sum({channel_sql('t', 'viridis', 3)}) AS BIGINT) AS sum_b FROM s GROUP BY image",
    "stretches": f"WITH {PX}, {RG}, {NX} SELECT image, idx, round(x, 6) AS linear, round(CASE WHEN x <= 0 THEN 0e0 ELSE ln(1 + x * 999) / ln(1000e0) END, 6) AS log, round(sqrt(x), 6) AS sqrt, round({ASINH}, 6) AS asinh, round(sinh(3e0 * x) / sinh(3e0), 6) AS sinh, round({MTF('x', '0.3e0')}, 6) AS mtf FROM nx",
    "scaling_overrides": f"WITH {PX} SELECT image, idx, round(greatest(0e0, least(1e0, (v - 50000e0) / 250000e0)), 6) AS scaled, v < 50000e0 AS is_underflow, v > 300000e0 AS is_overflow FROM px",
    "scaling_percentile": f"WITH {PX}, {PCT} SELECT image, idx, round(low, 6) AS low, round(high, 6) AS high, round(greatest(0e0, least(1e0, (v - low) / (high - low))), 6) AS scaled, v < low AS is_underflow, v > high AS is_overflow FROM px JOIN pr USING (image)",
    "flag_counts": f"WITH {PX}, {PCT} SELECT image, count(*) FILTER (WHERE v < low) AS n_under, count(*) FILTER (WHERE v > high) AS n_over, min(idx) FILTER (WHERE v < low) AS first_under, max(idx) FILTER (WHERE v > high) AS last_over FROM px JOIN pr USING (image) GROUP BY image",
    "scaling_equalized": f"WITH {PX}, e AS (SELECT image, list_sort(list(v))[CAST(floor(count(*) * 0.01e0) AS BIGINT) + 1] AS a, list_sort(list(v))[CAST(floor(count(*) * 0.99e0) AS BIGINT) + 1] AS b FROM px GROUP BY image), q AS (SELECT px.image, idx, v, a, b, CASE WHEN b > a AND v >= a AND v <= b THEN least(65535, floor((v - a) / (b - a) * 65535)) END AS bin FROM px JOIN e USING (image)), c AS (SELECT image, bin, count(*) AS n FROM q WHERE bin IS NOT NULL GROUP BY image, bin), d AS (SELECT image, bin, sum(n) OVER (PARTITION BY image ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY image) AS cdf FROM c) SELECT q.image, idx, round(CASE WHEN b <= a THEN 0.5e0 WHEN v <= a THEN 0e0 WHEN v >= b THEN 1e0 ELSE cdf END, 6) AS scaled FROM q LEFT JOIN d ON q.image = d.image AND q.bin = d.bin",
    "scaling_mtf_auto": f"WITH {PX}, {RG}, {NX}, md AS (SELECT image, greatest(0.01e0, least(0.99e0, median(x))) AS m FROM nx GROUP BY image) SELECT nx.image, idx, round({MTF('x', 'm')}, 6) AS scaled FROM nx JOIN md USING (image)",
    "zscale_range": f"{zscale_ctes(True)} SELECT image, round(low, 3) AS low, round(high, 3) AS high FROM zr",
    "scaling_zscale": f"{zscale_ctes(False)} SELECT image, round(avg(CASE WHEN high <= low THEN 0e0 ELSE greatest(0e0, least(1e0, (v - low) / (high - low))) END), 5) AS mean_scaled, count(*) FILTER (WHERE v > high) AS n_over FROM px JOIN zr USING (image) GROUP BY image",
    "histogram_fixed": f"WITH {PX}, im AS (SELECT DISTINCT image FROM px), s AS (SELECT image, CAST(b AS INTEGER) AS bin FROM im, range(16) t(b)), c AS (SELECT image, CAST(least(floor((v - 1000) / 25000e0), 15) AS INTEGER) AS bin, count(*) AS n FROM px WHERE v BETWEEN 1000 AND 401000 GROUP BY 1, 2), j AS (SELECT s.image, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.image = c.image AND s.bin = c.bin) SELECT image, bin, 1000 + bin * 25000e0 AS x0, 1000 + (bin + 1) * 25000e0 AS x1, n, round(n / greatest(1, max(n) OVER (PARTITION BY image)) * 76e0, 6) AS height, 1000 + bin * 25000e0 >= 26000 AND 1000 + (bin + 1) * 25000e0 <= 201000 AS in_range FROM j",
    "histogram_by_image": f"WITH {PX}, g AS (SELECT image, min(v) AS low, max(v) AS high, (max(v) - min(v)) / 20 AS w FROM px GROUP BY image), s AS (SELECT image, low, w, CAST(b AS INTEGER) AS bin FROM g, range(20) t(b) WHERE high > low), c AS (SELECT px.image, CAST(least(floor((v - low) / w), 19) AS INTEGER) AS bin, count(*) AS n FROM px JOIN g ON g.image = px.image GROUP BY 1, 2), j AS (SELECT s.image, s.bin, low, w, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.image = c.image AND s.bin = c.bin) SELECT image, bin, round(low + bin * w, 6) AS x0, round(low + (bin + 1) * w, 6) AS x1, n, round(n / greatest(1, max(n) OVER (PARTITION BY image)) * 76e0, 6) AS height FROM j",
    "flag_lists": f"WITH {PX}, {PCT.replace('0.1e0', '0.01e0').replace('0.9e0', '0.99e0')} SELECT image, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE v < low), '') AS underflow, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE v > high), '') AS overflow FROM px JOIN pr USING (image) GROUP BY image",
    "histogram_handles": "SELECT least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high, round(least(l_discount, l_tax) / 0.1e0 * 100, 6) AS low_percent, round(greatest(l_discount, l_tax) / 0.1e0 * 100, 6) AS high_percent, count(*) AS n FROM lineitem GROUP BY ALL",
    "color_bars": color_bars_sql(),
    "luma_invert": "WITH e AS (SELECT vec_id, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 255 % 256) AS INTEGER) AS r, CAST(floor(abs(CAST(embedding[2] AS DOUBLE)) * 255 % 256) AS INTEGER) AS g, CAST(floor(abs(CAST(embedding[3] AS DOUBLE)) * 255 % 256) AS INTEGER) AS b FROM embeddings) SELECT vec_id, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6) AS luma, 255 - r AS inv_r, 255 - g AS inv_g, 255 - b AS inv_b FROM e",
    "alpha_composite": "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings) SELECT vec_id, round(((a * 0.8e0 + b * 0.2e0) * 0.6e0 + c * 0.4e0) * 0.4e0 + d * 0.6e0, 6) AS value FROM e",
    **{f"resample_{m}": resampled_sql(m) for m in resample.METHODS},
    "median_stack": "WITH e AS (SELECT label, CAST(unnest(range(64)) AS INTEGER) AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, idx, round(median(v), 6) AS median, count(*) AS n FROM e GROUP BY label, idx",
    "display_pipeline": f"WITH px AS (SELECT o_orderpriority AS image, o_orderkey AS idx, 0.299e0 * (CAST(floor(o_totalprice) AS BIGINT) % 256) + 0.587e0 * (o_orderkey % 256) + 0.114e0 * (o_orderkey * 7 % 256) AS v FROM orders), {RG}, {NX} SELECT image, idx, 255 - {channel_sql('sqrt(x)', 'hot', 1)} AS r, 255 - {channel_sql('sqrt(x)', 'hot', 2)} AS g, 255 - {channel_sql('sqrt(x)', 'hot', 3)} AS b FROM nx",
    "hook_upscale": "SELECT vec_id, CAST(256 AS BIGINT) AS n, round(4 * list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
}
