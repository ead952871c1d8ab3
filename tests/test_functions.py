import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orelens.functions import geodesy, indices
from orelens.model import BandMap, Raster, load_config
from orelens.plans import planner


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "name, bands, want",
    [
        ("ndvi", dict(nir=0.8, red=0.2), 0.6),
        ("ndwi", dict(green=0.6, nir=0.2), 0.5),
        ("bsi", dict(swir=0.5, red=0.3, nir=0.4, blue=0.2), 0.2 / 1.4),
        ("ndre", dict(rededge=0.6, red=0.2), 0.5),
        ("vari", dict(green=0.5, red=0.3, blue=0.2), 0.2 / 0.6),
        ("sar_ratio", dict(vv=0.4, vh=0.1), 4.0),
        ("iron_oxide", dict(red=0.6, blue=0.3), 2.0),
        ("exg", dict(green=0.5, red=0.3, blue=0.2), 0.5),
        ("exr", dict(red=0.5, green=0.3), 0.4),
        ("brightness", dict(red=0.3, green=0.6, blue=0.9), 0.6),
        ("hue", dict(red=1.0, green=0.0, blue=0.0), 0.0),
        ("hue", dict(red=0.0, green=1.0, blue=0.0), 1 / 3),
        ("hue", dict(red=0.0, green=1.0, blue=1.0), (60 * (0 - 1) + 240) / 360),
        ("hue", dict(red=0.5, green=0.5, blue=0.5), 0.0),
        ("saturation", dict(red=1.0, green=0.5, blue=0.5), 0.5),
        ("saturation", dict(red=0.0, green=0.0, blue=0.0), 0.0),
    ],
)
def test_known_values(spark, name, bands, want):
    function, roles = indices.INDICES[name]
    assert one(spark, function(*[F.col(r) for r in roles]), **bands) == pytest.approx(want)


def test_invalid_values_are_null(spark):
    assert one(spark, indices.ndvi(F.col("a"), F.col("b")), a=0.0, b=0.0) is None
    assert one(spark, indices.safe_ratio(F.col("a"), F.col("b"), -1.0), a=1.0, b=0.0) == -1.0
    assert one(spark, indices.hue(F.col("a"), F.col("a"), F.lit(None).cast("double")), a=1.0) is None
    assert one(spark, indices.sar_ratio(F.col("a"), F.col("b"), True), a=-1.0, b=1.0) is None
    assert one(spark, indices.sar_ratio(F.col("a"), F.col("b"), True), a=100.0, b=1.0) == pytest.approx(20.0)
    assert one(spark, indices.subtract_dark(F.col("a"), F.lit(10.0), "uint8"), a=5.0) == 0.0
    assert one(spark, indices.subtract_dark(F.col("a"), F.lit(10.0), "uint8"), a=900.0) == 255.0


def test_overlap(spark):
    box = lambda *v: dict(zip(("left", "bottom", "right", "top"), map(F.lit, v)))
    pct = lambda a, b: one(spark, indices.overlap_pct(box(*a), box(*b)), x=1.0)
    assert pct((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0)) == pytest.approx(50.0)
    assert pct((0.0, 0.0, 10.0, 10.0), (2.0, 2.0, 4.0, 4.0)) == pytest.approx(100.0)
    assert pct((0.0, 0.0, 10.0, 10.0), (10.0, 0.0, 20.0, 10.0)) == 0.0
    assert pct((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)) == 0.0


def test_utm(spark):
    """A published pair: the CN Tower."""
    x, y = geodesy.to_projected(F.col("lon"), F.col("lat"), 32617)
    assert one(spark, x, lon=-79.387139, lat=43.642567) == pytest.approx(630084, abs=1.5)
    assert one(spark, y, lon=-79.387139, lat=43.642567) == pytest.approx(4833439, abs=1.5)
    lon, lat = geodesy.to_degrees(*geodesy.to_projected(F.col("lon"), F.col("lat"), 32733), 32733)
    assert one(spark, lon, lon=16.2, lat=-33.9) == pytest.approx(16.2, abs=1e-8)
    assert one(spark, lat, lon=16.2, lat=-33.9) == pytest.approx(-33.9, abs=1e-8)
    with pytest.raises(ValueError):
        geodesy.utm_zone(3857)


def test_planner_order_and_options():
    every = BandMap.of(["nir", "red", "green", "blue", "swir", "rededge", "vv", "vh", "dem"])
    base = planner.active_features(every)
    assert base == ["ndvi", "ndwi", "bsi", "ndre", "vari", "sar_ratio", "slope", "aspect", "glcm_contrast", "glcm_homogeneity", "glcm_correlation"]
    assert planner.active_features(every, {"mining_features_enabled": True})[11:] == ["iron_oxide", "clay_index", "ferrous", "mndwi", "roughness_proxy", "exg", "exr", "brightness", "hue", "saturation"]
    assert planner.active_features(every, {"mining_features_enabled": False}) == base
    rgb = BandMap.of(["red", "green", "blue"])
    assert "hue" in planner.active_features(rgb, {"mining_features_enabled": False}) and "iron_oxide" not in planner.active_features(rgb, {})
    assert planner.active_features(every, None, ["hue", "ndvi"]) == ["ndvi", "hue"]
    assert planner.glcm_band(every) == "nir" and planner.summary_band(every) == "red"
    with pytest.raises(ValueError):
        planner.active_features(BandMap())


def test_adaptive_kernels_and_chain():
    assert [planner.adaptive_kernel_size(r, 2.0) for r in (10.0, 0.5, 0.1, 0.05)] == [3, 5, 21, 41]
    assert planner.adaptive_kernel_size(0.01, 2.0, 3, 10) == 10
    p = planner.drone_plan(0.2, {})
    assert [(x.method, x.kernel) for x in p.smoothing] == [("median", 3), ("majority", 9), ("majority", 15)] and not p.with_confidence
    assert p.closing_rounds == 3 and p.sieve_pixels == 50
    assert [x.kernel for x in planner.drone_plan(0.5, {}).smoothing] == [3, 5] and planner.drone_plan(0.5, {}).with_confidence
    assert [k for k, _ in planner.chain_steps(10.0, {})] == ["confidence_filter", "median_smooth", "morphological_close", "sieve_filter"]
    times = planner.estimate_chain_time(120_560_400, {}, 10.0)
    assert times["median_smooth"] == pytest.approx(144.67, abs=0.01) and "warning" in times
    assert planner.estimate_chain_time(1000, {}, 0.3)["confidence_filter"] == 0


def test_sql_functions(spark):
    indices.register_sql_functions(spark)
    row = spark.sql("SELECT ndvi(0.8D, 0.2D) a, ndvi(0D, 0D) b, brightness(1D, 2D, 3D) c").first()
    assert row.a == pytest.approx(0.6) and row.b is None and row.c == 2.0


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("drift_alert_pct: 5\nnew: {a: 1}\n")
    cfg = load_config(tmp_path / "c.yaml", {"default_k_folds": 3})
    assert (cfg["drift_alert_pct"], cfg["new"], cfg["default_k_folds"], cfg["glcm_levels"]) == (5, {"a": 1}, 3, 32)
    assert load_config(tmp_path / "missing.yaml")["drift_alert_pct"] == 20
    assert Raster(10, 20, 2.0, 100.0, 50.0, 32633).bounds == (100.0, 10.0, 120.0, 50.0)
    assert Raster(1, 1, 2.0, epsg=4326).gsd_m is None and Raster(1, 1, 2.0, epsg=32601).gsd_m == 2.0


def test_polygon_with_a_hole(spark):
    rings = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]
    df = spark.createDataFrame([(rings, x, y) for x, y in ((1.0, 1.0), (5.0, 5.0), (11.0, 5.0), (5.0, 7.0))], "rings array<array<struct<x:double,y:double>>>, x double, y double")
    assert [r.v for r in df.select(geodesy.contains(F.col("rings"), F.col("x"), F.col("y")).alias("v")).collect()] == [True, False, False, True]
    assert math.isfinite(np.pi)
