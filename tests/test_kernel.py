"""Pinned values of the sky kernel."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import color as C
from starloom.functions import coordtext as X
from starloom.functions import dates
from starloom.functions import geometry as G
from starloom.functions import stretch as S
from starloom.functions.tileindex import nside, tile_index, tile_url
from starloom.operators import catalog, epochs, hooks, matching, ranks, resample, tiling
from starloom.operators.histogram import histogram
from starloom.operators.scaling import Scaling, apply_scaling, clean, flag_lists, zscale_fit, zscale_range


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def image(spark, values, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "image string, idx long, value double")


def norm(v, low, high):
    return S.normalize(F.lit(float(v)), F.lit(float(low)), F.lit(float(high)))


def test_stretches(spark):
    r = one(spark, norm(5, 0, 10), norm(-5, 0, 10), norm(15, 0, 10), norm(1, 3, 3), S.log(norm(50, 0, 100)), S.sqrt(norm(25, 0, 100)), S.asinh(norm(50, 0, 100)), S.sinh(norm(50, 0, 100)), S.mtf(norm(30, 0, 100), 0.3), S.mtf(F.lit(0.4), 0.2), S.mtf(F.lit(0.4), 0.8))
    assert r[:4] == (0.5, 0.0, 1.0, 0.0)
    assert r[4] == pytest.approx(math.log(500.5) / math.log(1000)) and r[5] == 0.5
    assert r[6] == pytest.approx(math.asinh(5) / math.asinh(10)) and r[7] == pytest.approx(math.sinh(1.5) / math.sinh(3))
    assert r[8] == pytest.approx(0.5) and r[9] > 0.4 > r[10]


def test_rounding_and_bad_pixels(spark):
    assert one(spark, S.js_round(F.lit(-2.5)), S.js_round(F.lit(2.5)))[:] == (-2, 3)
    out = apply_scaling(image(spark, [math.nan, math.inf, -math.inf, 5, 10]), Scaling("linear")).collect()
    assert all(0 <= r.scaled <= 1 for r in out) and len(out) == 5


def test_flags_and_overrides(spark):
    r = flag_lists(apply_scaling(image(spark, [0, 50, 100]), Scaling("linear", low=20, high=80))).first()
    assert (r.underflow, r.overflow) == ([0], [2])
    r = flag_lists(apply_scaling(image(spark, [0, 5, 10, 15, 20]), Scaling("linear", low=5, high=15))).first()
    assert (r.underflow, r.overflow) == ([0], [4])


def test_ranges(spark):
    r = apply_scaling(image(spark, range(100)), Scaling("percentile", low_percentile=10, high_percentile=90)).first()
    assert (r.low, r.high) == (9, 89)
    rng = lambda n: apply_scaling(image(spark, range(n)), Scaling("linear")).first()
    assert (rng(100).low, rng(100).high) == (0, 99) and (rng(101).low, rng(101).high) == (1, 99)
    assert {x.scaled for x in apply_scaling(image(spark, [7] * 5), Scaling("histogram")).collect()} == {0.5}
    assert {x.scaled for x in apply_scaling(image(spark, [7] * 5), Scaling("linear")).collect()} == {0.0}


def test_rank_brackets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 10)
    v = np.random.default_rng(1).normal(size=30_000).round(2)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    r = ranks.nearest_rank(df, ["k"], "v", {"a": (0.01, "gaps"), "b": (0.99, "gaps"), "c": (0.5, "items")}).first()
    s = np.sort(v)
    assert (r.a, r.b, r.c) == (s[math.floor(0.01 * 29_999)], s[math.floor(0.99 * 29_999)], s[15_000])


def test_positions(spark):
    df = spark.createDataFrame([(k, i * 3) for k in (1, 2) for i in range(50)], "k int, o int")
    assert all(r.pos == r.o // 3 for r in ranks.positions(df, ["k"], "o", partitions=7).collect())


def test_zscale(spark):
    z = lambda v: zscale_range(clean(image(spark, v), "image", "idx", "value")).first()[1:]
    assert z([42]) == (42, 42) and z([0] * 5) == (0, 0) and z([3, 9]) == (3, 9)
    low, high = z([0] * 5 + list(range(50, 101)))
    assert low >= 50 and high <= 100
    assert z(list(range(1, 196)) + [10_000, 100_000, 500_000])[1] < 500_000
    v = [1.0 + (i * 7919) % 20_011 for i in range(20_000)]
    assert z(v) == pytest.approx(zscale_fit(np.sort([v[i * 20_000 // 10_000] for i in range(10_000)]), 0.25))
    with pytest.raises(ValueError):
        Scaling("sideways")


def test_colors(spark):
    r = one(spark, C.color(F.lit(0.5), "viridis"), C.color(F.lit(0.5), "grayscale"), C.color(F.lit(math.nan), "hot"), C.color(F.lit(0.25), [(0, 0, 0, 0), (0.5, 100, 200, 50), (1, 255, 255, 255)]))
    assert [tuple(x) for x in r] == [(31, 161, 135, 255), (128, 128, 128, 255), (0, 0, 0, 255), (50, 100, 25, 255)]


def test_resampling(spark):
    at = lambda x, y, m: resample.sample(F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0))), F.lit(2), F.lit(2), F.lit(x), F.lit(y), m)
    assert one(spark, at(0.3, 0.3, "nearest"), at(0.6, 0.6, "nearest"), at(1.4, 0.4, "nearest"), at(0.5, 0.5, "bilinear"), at(-9.0, -9.0, "bilinear"))[:] == (10, 40, 20, 25, 10)
    nine = F.array(*(F.lit(float(k)) for k in range(9)))
    for m in resample.METHODS:
        r = one(spark, *(resample.sample(nine, F.lit(3), F.lit(3), F.lit(float(k % 3)), F.lit(float(k // 3)), m).alias(str(k)) for k in range(9)))
        assert list(r) == pytest.approx(list(range(9)))
    up = resample.resample(spark.range(1).select(F.lit(2).alias("w"), F.lit(2).alias("h"), F.array(*map(F.lit, (10.0, 20.0, 30.0, 40.0))).alias("data")), 4, 4, "nearest").first().resampled
    assert up == [10, 10, 20, 20, 10, 10, 20, 20, 30, 30, 40, 40, 30, 30, 40, 40]
    assert one(spark, resample.cubic_weight(F.lit(0.0)), resample.cubic_weight(F.lit(2.5)), resample.lanczos_weight(F.lit(3.0)), resample.sinc(F.lit(0.0)))[:] == (1, 0, 0, 1)


def test_tiles(spark):
    assert one(spark, *(nside(F.lit(k)) for k in (0, 1, 3, 11)))[:] == (1, 2, 8, 2048)
    t = lambda ra, dec: tile_index(F.lit(ra), F.lit(dec), F.lit(8))
    r = one(spark, t(0.0, 10.0), t(360.0, 10.0), t(-90.0, 20.0), t(270.0, 20.0))
    assert r[0] == r[1] and r[2] == r[3]
    r = one(spark, tile_url(F.lit(3), F.lit(42), base="s"), tile_url(F.lit(3), F.lit(25003), base="s/"), tile_url(F.lit(3), F.lit(35000), "fits", "s/properties"))
    assert r[:] == ("s/Norder3/Dir0/Npix42.png", "s/Norder3/Dir20000/Npix25003.png", "s/Norder3/Dir30000/Npix35000.fits")
    assert tiling.tile_centers(spark, 3).count() <= 416 and tiling.tile_centers(spark, 3, "standard").count() == 768
    back = tiling.tile_centers(spark, 3, "standard").withColumn("again", tile_index(F.col("ra"), F.col("dec"), F.lit(8), "standard"))
    assert back.where("again <> pix").count() == 0


def test_visible_tiles_at_the_pole(spark):
    v = spark.createDataFrame([(1, 10.0, 90.0, 5.0, 4)], "view_id long, ra double, dec double, fov double, ord int")
    assert 0 < tiling.visible_tiles(v).count() < 3000


def test_projection_round_trip(spark):
    view = {"ra0": 62.0, "dec0": -37.0, "fov": 22.5, "width": 800.0, "height": 600.0}
    x, y = G.project(F.col("ra"), F.col("dec"), **view)
    pts = spark.createDataFrame([(60.0, -35.0), (62.0, -37.0), (65.0, -40.0)], "ra double, dec double").select("ra", "dec", x.alias("x"), y.alias("y"))
    ra, dec = G.unproject(F.col("x"), F.col("y"), **view)
    for r in pts.select("ra", "dec", ra.alias("a"), dec.alias("d")).collect():
        assert (r.a, r.d) == (pytest.approx(r.ra), pytest.approx(r.dec))
    assert one(spark, *(G.project(F.lit(242.0), F.lit(37.0), **view)))[:] == (None, None)


def test_view_arithmetic(spark):
    assert one(spark, *(G.grid_spacing(F.lit(f)) for f in (50.0, 25.0, 15.0, 6.0, 3.0, 1.5, 0.8, 0.3, 0.1)))[:] == (10, 5, 2, 1, 0.5, 0.2, 0.1, 0.05, 0.02)
    assert one(spark, G.zoom_fov(F.lit(0.0)), G.zoom_fov(F.lit(1.0)), G.zoom_fov(F.lit(3.0)), G.zoom_order(F.lit(20.0)))[:] == (180, 90, 22.5, 13)


@pytest.mark.parametrize(("text", "mode", "want"), [("62.0, -37.0", "lenient", (62, -37, None)), ("400, -37.0", "lenient", (None, None, X.RA_ERROR)), ("62.0, -100", "strict", (None, None, X.DEC_ERROR)), ("04h08m00s -37d00m00s", "lenient", (62, -37, None)), ("12h 30d", "strict", (180, 30, None)), ("12h 30d", "lenient", (None, None, X.LENIENT_ERROR)), ("0h -45d30m", "strict", (0, -45.5, None)), ("0h0m0s -0d30m", "lenient", (0, -0.5, None)), ("", "strict", (None, None, None))])
def test_coordinate_text(spark, text, mode, want):
    p = X.parse(F.lit(text), mode)
    r = one(spark, p["ra"], p["dec"], p["error"])
    assert r[2] == want[2] and all(a == (pytest.approx(b) if b is not None else None) for a, b in zip(r[:2], want[:2], strict=True))


def test_formats_and_dates(spark):
    assert one(spark, X.format_ra(F.lit(90.0)), X.format_dec(F.lit(45.5)), X.format_dec(F.lit(-12.5)), X.exponential(F.lit(12345.6)))[:] == ("06h00m00.00s", "+45d30m00.0s", "-12d30m00.0s", "1.235e+4")
    assert [str(x) for x in one(spark, *(dates.mjd_to_date(F.lit(float(m))) for m in (0, 60000, 40587)))] == ["1858-11-17", "2023-02-25", "1970-01-01"]


def test_token_expiry(spark):
    import base64

    body = base64.urlsafe_b64encode(b'{"sub":"a","exp":1700000000}').decode().rstrip("=")
    assert one(spark, dates.token_expiry(F.lit(f"x.{body}.y")), dates.token_expiry(F.lit("nothing")))[:] == (1_700_000_000.0, None)


def test_display_bypass(spark):
    from starloom.operators.display import display

    rgb = spark.createDataFrame([("a", 0, 1, 2, 3), ("a", 1, 200, 100, 50)], "image string, idx long, r int, g int, b int")
    assert display(rgb).collect() == rgb.collect()
    assert [r[2:] for r in display(rgb, inverted=True).orderBy("idx").collect()] == [(255, 255, 255), (0, 0, 0)]


def test_histogram(spark):
    h = histogram(spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.5, 0.5, 1.0, 1.0)], "v double"), "v", 0, 1, 4)
    assert [r.n for r in h.orderBy("bin").collect()] == [2, 0, 2, 2]
    h = histogram(spark.createDataFrame([(x,) for x in (-1.0, 0.5, 2.0, 0.7, math.nan)], "v double"), "v", 0, 1, 4)
    assert sum(r.n for r in h.collect()) == 2


def test_epochs_and_hooks(spark):
    g = epochs.generated(spark, 30, 1).collect()
    assert [r.mjd for r in g] == sorted(r.mjd for r in g) and all(59_900 < r.mjd < 61_000 for r in g)
    hooks.clear()
    hooks.register("same", lambda d, w, h, f: d)
    names = hooks.registered()
    names.append("x")
    assert hooks.registered() == ["same"]
    hooks.clear()
    assert hooks.registered() == []


def test_catalog(spark):
    o = spark.createDataFrame([(1, "M1", "M1 (Crab Nebula)", "Messier", None), (2, "N1", "Other", "Nebulae", "a crab")], "ord int, id string, name string, category string, description string")
    assert catalog.search(o, "  ").count() == 2 and catalog.search(o, "CRAB").count() == 2 and catalog.search(o, " crab ").count() == 0
    assert catalog.lookup(o, " m1 ").first().ord == 1 and catalog.lookup(o, "").first().ord == 1
    assert catalog.toggle_band("g", "g") is None and catalog.toggle_band(None, "r") == "r"


def test_positions_of_many_rows_with_a_value(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % n).alias("o"), F.rand(3).alias("v"))
    got = ranks.positions(df, ["g"], "o", partitions=7)
    assert got.columns == ["g", "o", "v", "pos"]
    bad = got.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1).where("want <> pos").count()
    assert bad == 0 and got.count() == n


def test_zscale_of_negative_contrast_keeps_its_order():
    low, high = zscale_fit(np.arange(1.0, 200.0), -0.25)
    assert low <= high


def test_as_of_in_slices(spark):
    rng = np.random.default_rng(4)
    left = spark.createDataFrame([(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 60, 200), strict=True))], "k int, t double, i int")
    right = spark.createDataFrame([(int(k), float(t), float(t)) for k, t in {(int(a), int(b)) for a, b in zip(rng.integers(0, 2, 40), rng.integers(0, 60, 40), strict=True)}], "k int, t double, v double")
    plain = {r.i: r.v for r in matching.as_of(left, right, "k", "t", "v").collect()}
    assert len(plain) == 200 and {r.i: r.v for r in matching.as_of(left, right, "k", "t", "v", 10.0).collect()} == plain
    assert None in plain.values() and any(v is not None for v in plain.values())


def test_tile_centres_go_to_the_last_order(spark):
    with pytest.raises(ValueError):
        tiling.tile_centers(spark, 14)
    assert tiling.tile_centers(spark, 13).columns == ["ord", "pix", "ra", "dec"]
    assert 12 * 4**7 - 8 < tiling.tile_centers(spark, 7, "standard").count() <= 12 * 4**7  # a few at the poles lie between the grid's places


def test_tab_is_white_space(spark):
    p = X.parse(F.lit("\t"), "lenient")
    assert one(spark, *p.values())[:] == (None, None, None)
