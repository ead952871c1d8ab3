import numpy as np
import pytest
from pyspark.sql import functions as F

from orelens.model import BandMap, Raster
from orelens.operators import components, focal, grid, preprocess, stats, texture, workflow

from .grids import array, class_table, table

RNG = np.random.default_rng(42)


def window(a, p, mode):
    """(k*k, h, w) of the cells around each."""
    padded = np.pad(a, p, mode={"mirror": "reflect", "symmetric": "symmetric", "nearest": "edge"}[mode])
    k, (h, w) = 2 * p + 1, a.shape
    return np.array([padded[i : i + h, j : j + w] for i in range(k) for j in range(k)])


@pytest.mark.parametrize("mode", ["mirror", "symmetric", "nearest"])
@pytest.mark.parametrize("p", [1, 2])
def test_padding(spark, mode, p):
    a = RNG.random((5, 6))
    got = grid.pad(table(spark, v=a), 5, 6, p, mode)
    want = np.pad(a, p, mode={"mirror": "reflect", "symmetric": "symmetric", "nearest": "edge"}[mode])
    assert got.count() == want.size
    shifted = got.withColumns({"row": F.col("row") + p, "col": F.col("col") + p})
    assert np.allclose(array(shifted, "v", want.shape), want)


def test_box_sums_and_integral_image(spark):
    a = RNG.random((7, 9))
    got = preprocess.integral_image(table(spark, v=a), "v")
    assert np.allclose(array(got, "integral", a.shape), a.cumsum(0).cumsum(1))
    got = preprocess.local_mean_var(table(spark, v=a), "v", 3, 7, 9)
    w = window(a, 1, "mirror")
    assert np.allclose(array(got, "mean", a.shape), w.mean(0)) and np.allclose(array(got, "var", a.shape), w.var(0))
    for bad in (2, 1, 3.0, True):
        with pytest.raises(ValueError):
            preprocess.local_mean_var(table(spark, v=a), "v", bad, 7, 9)


def test_lee(spark):
    a = RNG.random((8, 8)) + 1
    a[2, 3] = np.nan
    x = np.where(np.isnan(a), np.nanmean(a), a)
    w = window(x, 1, "mirror")
    mean, var = w.mean(0), w.var(0)
    noise = (mean / 4.9) ** 2
    want = np.where(np.isnan(a), np.nan, mean + var / (var + noise) * (x - mean))
    assert np.allclose(array(preprocess.lee_filter(table(spark, v=a), "v", 8, 8, 3, 4.9), "v", a.shape), want, equal_nan=True)
    flat = np.full((4, 4), 3.0)
    assert np.allclose(array(preprocess.lee_filter(table(spark, v=flat), "v", 4, 4, 3), "v", flat.shape), flat)


def test_dark_objects(spark):
    a, b = np.array([[0.0, 5.0], [9.0, np.nan]]), np.zeros((2, 2))
    pixels = table(spark, a=a, b=b)
    assert tuple(preprocess.dark_object_values(pixels, ["a", "b"]).first()) == (5.0, 0.0)
    assert np.allclose(array(preprocess.dos1(pixels, ["a", "b"], "uint8"), "a", (2, 2)), [[0, 0], [4, np.nan]], equal_nan=True)
    assert preprocess.band_means(pixels, ["a", "b"], 2).first().b == 1.0


def test_terrain(spark):
    a = RNG.random((6, 7)) * 50
    got = focal.terrain(table(spark, dem=a), "dem", 2.0)
    dy, dx = np.gradient(a, 2.0, 2.0)
    assert np.allclose(array(got, "slope", a.shape), np.hypot(dx, dy))
    assert np.allclose(array(got, "aspect", a.shape), np.degrees(np.arctan2(-dy, dx)) % 360)
    a[3, 3] = np.nan
    got = array(focal.terrain(table(spark, dem=a), "dem", 2.0), "slope", a.shape)
    assert np.isnan(got[3, 3]) and np.isnan(got[3, 2]) and np.isnan(got[2, 3]) and not np.isnan(got[0, 0])
    s = RNG.random((5, 5))
    s[0, 1] = np.nan
    want = np.where(np.isnan(s), np.nan, np.nanstd(window(s, 1, "nearest"), axis=0))
    assert np.allclose(array(focal.roughness(table(spark, s=s), "s", 5, 5), "roughness_proxy", s.shape), want, equal_nan=True)


def majority(a, p):
    out = a.copy()
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if a[r, c] >= 0:
                cells = [a[min(max(r + i, 0), a.shape[0] - 1), min(max(c + j, 0), a.shape[1] - 1)] for i in range(-p, p + 1) for j in range(-p, p + 1)]
                cells = [x for x in cells if x >= 0]
                out[r, c] = min(sorted(set(cells)), key=lambda v: (-cells.count(v), v))
    return out


@pytest.mark.parametrize("k", [3, 5])
def test_class_filters(spark, k):
    a = RNG.integers(-1, 4, (9, 10))
    df = class_table(spark, a, conf=RNG.random(a.shape))
    got = lambda x: array(x, "cls", a.shape, -1).astype(int)
    assert (got(focal.majority_filter(df, "cls", 9, 10, k)) == majority(a, k // 2)).all()
    assert (got(focal.morphological_close(df, "cls", 9, 10, k)) == majority(majority(a, k // 2), k // 2)).all()
    med = np.median(window(a, k // 2, "symmetric"), axis=0).astype(int)
    assert (got(focal.median_smooth(df, "cls", 9, 10, k)) == np.where(a < 0, -1, med)).all()
    conf = array(df, "conf", a.shape)
    assert (got(focal.confidence_filter(df, "cls", "conf", 9, 10, 0.6, k)) == np.where((a >= 0) & (conf < 0.6), med, a)).all()


def label(a, eight):
    out, n = np.full(a.shape, -1), a.shape[1]
    for r in range(a.shape[0]):
        for c in range(n):
            if a[r, c] >= 0 and out[r, c] < 0:
                todo, out[r, c] = [(r, c)], r * n + c
                while todo:
                    y, x = todo.pop()
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            if (eight or i * j == 0) and 0 <= y + i < a.shape[0] and 0 <= x + j < n and a[y + i, x + j] == a[r, c] and out[y + i, x + j] < 0:
                                out[y + i, x + j] = r * n + c
                                todo.append((y + i, x + j))
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_tiles(spark, eight):
    a = np.where(RNG.random((13, 11)) < 0.55, 1, 2)
    a[RNG.random(a.shape) < 0.05] = -1
    got = components.label_components(class_table(spark, a), "cls", 11, 8 if eight else 4, 4)
    assert (array(got, "label", a.shape, -1).astype(int) == label(a, eight)).all()
    with pytest.raises(ValueError):
        components.label_components(class_table(spark, a), "cls", 11, 6)


def test_sieve(spark):
    a = np.ones((10, 10), int)
    a[2, 2] = 2
    a[5:9, 5:9] = 3
    a[6, 6] = 4
    a[0, 0] = -1
    got = array(components.sieve(class_table(spark, a), "cls", 10, 4, 4, 4), "cls", a.shape, -1).astype(int)
    want = a.copy()
    want[2, 2], want[6, 6] = 1, 3
    assert (got == want).all()
    two = np.array([[1, 2]])
    assert (array(components.sieve(class_table(spark, two), "cls", 2, 5), "cls", two.shape, -1) == two).all()
    assert components.sieve_threshold(0.5, 10.0) == 50 and components.sieve_threshold(0.0, 10.0) == 1


def glcm(q, levels, steps):
    mats = []
    for dr, dc in steps:
        m = np.zeros((levels, levels))
        for r in range(q.shape[0]):
            for c in range(q.shape[1]):
                if 0 <= r + dr < q.shape[0] and 0 <= c + dc < q.shape[1]:
                    m[q[r, c], q[r + dr, c + dc]] += 1
        m += m.T
        mats.append(m / m.sum())
    return mats


def test_texture(spark):
    a = RNG.random((8, 8)) * 9
    a[1, 1] = np.nan
    x = np.where(np.isnan(a), np.nanmean(a), a)
    i, j = np.meshgrid(range(32), range(32), indexing="ij")
    q = lambda levels: np.clip(((x - np.nanmin(a)) / (np.nanmax(a) - np.nanmin(a)) * (levels - 1)).astype(int), 0, levels - 1)
    tiles = texture.tiles_of(table(spark, v=a), "v", 8)
    (p,) = glcm(q(16), 16, [(0, 1)])
    d = i[:16, :16] - j[:16, :16]
    got = texture.glcm_tile(tiles, "v", 16).first()
    assert got.contrast == pytest.approx((p * d**2).sum()) and got.homogeneity == pytest.approx((p / (1 + abs(d))).sum())
    assert got.entropy == pytest.approx(-(p * np.log2(p + 1e-12)).sum())
    ps = glcm(q(32), 32, [(0, 1), (-1, 1), (-1, 0), (-1, -1)])
    d = i - j
    got = texture.glcm_directional(tiles, "v", 32).first()
    assert got.contrast == pytest.approx(np.mean([(p * d**2).sum() for p in ps]))
    assert got.homogeneity == pytest.approx(np.mean([(p / (1 + d**2)).sum() for p in ps]))
    corr = [((p * i * j).sum() - (p * i).sum() * (p * j).sum()) / np.sqrt(((p * i * i).sum() - (p * i).sum() ** 2) * ((p * j * j).sum() - (p * j).sum() ** 2)) for p in ps]
    assert got.correlation == pytest.approx(np.mean(corr))
    mean = np.mean(ps, axis=0)
    assert got.entropy == pytest.approx(-(mean * np.log2(mean + 1e-12)).sum())
    flat = texture.glcm_directional(texture.tiles_of(table(spark, v=np.full((4, 4), 2.0)), "v", 4), "v").first()
    assert (flat.contrast, flat.homogeneity, flat.correlation, flat.entropy) == (0.0, 1.0, 0.0, 0.0)


def test_padded_tiles(spark):
    a = RNG.random((5, 6))
    got = texture.padded_tiles(table(spark, v=a), "v", 4, 5, 6, 3)
    sizes = {(r.tile_r, r.tile_c): (r.n, r.k) for r in got.groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.count("v").alias("k")).collect()}
    assert sizes == {(0, 0): (36, 25), (0, 1): (24, 15), (1, 0): (18, 10), (1, 1): (12, 6)}


def test_statistics(spark):
    a, b = RNG.random((6, 6)), RNG.random((6, 6))
    a[0, 0] = np.nan
    pixels = table(spark, a=a, b=b, c=2 * b, k=np.ones((6, 6)), none=np.full((6, 6), np.nan))
    got = {r.feature: r for r in stats.feature_stats(pixels, ["a", "b", "none"]).collect()}
    assert got["a"].std == pytest.approx(np.nanstd(a)) and got["a"].valid_pct == pytest.approx(100 * 35 / 36)
    assert tuple(got["none"])[1:] == (0.0,) * 5
    r = {(x.a, x.b): x.r for x in stats.correlation(pixels, ["a", "b", "c", "k"]).collect()}
    ok = ~np.isnan(a)
    assert r["a", "b"] == pytest.approx(np.corrcoef(a[ok], b[ok])[0, 1]) and r["b", "c"] == pytest.approx(1.0)
    assert r["k", "a"] == 0.0 and r["k", "k"] == 1.0 and len(r) == 16
    high = stats.high_correlations(stats.correlation(pixels, ["b", "c"]), 0.95).collect()
    assert [(x.a, x.b) for x in high] == [("b", "c")]
    exact = spark.createDataFrame([("a", "b", 0.95), ("a", "c", -0.951)], "a string, b string, r double")
    assert [x.b for x in stats.high_correlations(exact, 0.95).collect()] == ["c"]
    assert {x.r for x in stats.correlation(pixels, ["a", "none"]).where("a <> b").collect()} == {0.0}


def test_areas_and_drift(spark):
    a = np.array([[1, 1, 2], [2, 2, -1]])
    got = {r.class_id: r for r in stats.class_areas(class_table(spark, a), "cls", 10.0).collect()}
    assert got[1].area_ha == pytest.approx(0.02) and got[2].area_pct == pytest.approx(60.0)
    assert stats.nodata_fraction(stats.class_areas(class_table(spark, a), "cls", 10.0), 2, 3).first()[0] == pytest.approx(1 / 6)
    with pytest.raises(ValueError):
        stats.class_areas(class_table(spark, a), "cls", None)
    now = spark.createDataFrame([(1, 12.0), (2, 5.0), (3, 0.0), (4, 9.99), (9, 1.0)], "class_id int, area_ha double")
    was = spark.createDataFrame([(1, 10.0), (2, 0.0), (3, 0.0), (4, 10.0), (8, 1.0)], "class_id int, area_ha double")
    got = {r.class_id: r for r in stats.drift(now, was, 20.0).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].flagged and got[1].pct_change == pytest.approx(20.0)
    assert got[2].flagged and got[2].is_new and got[2].pct_change is None
    assert not got[3].flagged and not got[4].flagged


def test_confidence_and_imbalance(spark):
    conf = np.array([[0.1, 0.6, 0.9, -1.0]])
    got = stats.confidence_stats(table(spark, conf=conf), "conf").first()
    assert (got.n_valid, got.n_above, got.n_below) == (3, 2, 1) and got.p50 == pytest.approx(0.6)
    rows = spark.createDataFrame([(1,)] * 9 + [(2,)], "label int")
    assert not stats.is_imbalanced(rows, "label", 10.0).first()[0] and stats.is_imbalanced(rows, "label", 10.1).first()[0]
    assert {(r["class"], r["count"], r.percentage) for r in stats.class_summary(rows, "label").collect()} == {(1, 9, 90.0), (2, 1, 10.0)}


def test_grid_helpers(spark):
    rows = grid.windows(spark, 5, 7, 4).collect()
    assert [(r.row_off, r.col_off, r.h, r.w) for r in rows] == [(0, 0, 4, 4), (0, 4, 4, 3), (4, 0, 1, 4), (4, 4, 1, 3)]
    assert grid.count_windows(5, 7, 4) == 4 and grid.block_size(20_000, 20_000, 4096) == 512
    a = RNG.random((8, 8))
    small = grid.overview(table(spark, v=a), 8, 8, ["v"], 4)
    assert np.allclose(array(small, "v", (4, 4)), a.reshape(4, 2, 4, 2).mean((1, 3)))
    big = grid.overview(table(spark, v=a), 8, 8, ["v"], 16)
    assert np.allclose(array(big, "v", (16, 16)), a.repeat(2, 0).repeat(2, 1))
    full = grid.complete(table(spark, v=a).where("row < 3"), 8, 8)
    assert full.count() == 64 and full.where("v is null").count() == 40


def test_compute_features(spark):
    h = w = 10
    bands = {n: RNG.random((h, w)) for n in ("red", "green", "blue", "nir", "dem")}
    bands["red"][0, 0] = np.nan
    out = workflow.compute_features(table(spark, **bands), BandMap.of(bands), Raster(w, h, 10.0), {"mining_features_enabled": True}, block=8)
    assert out.names[:2] == ("ndvi", "ndwi") and "roughness_proxy" in out.names and "glcm_contrast" in out.names
    want = (bands["nir"] - bands["red"]) / (bands["nir"] + bands["red"])
    assert np.allclose(array(out.pixels, "ndvi", (h, w)), want, equal_nan=True)
    assert out.stats.count() == len(out.names) and out.correlation.count() == len(out.names) ** 2
    assert {r.property for r in out.texture_summary.collect()} == {"contrast", "homogeneity", "entropy"}


def test_chain_runs_in_order_and_can_be_cancelled(spark):
    a = RNG.integers(1, 4, (12, 12))
    df = class_table(spark, a, conf=RNG.random(a.shape))
    seen = []
    cfg = {"min_mapping_unit_ha": 0.04}
    steps = workflow.postprocess_chain(df, Raster(12, 12, 10.0, epsg=32633), cfg, 10.0, on_step=seen.append)
    assert list(steps) == seen == ["confidence_filter", "median_smooth", "morphological_close", "sieve_filter"]
    assert steps["sieve_filter"].count() == 144
    steps = workflow.postprocess_chain(df, Raster(12, 12, 10.0), cfg, 10.0, cancelled=lambda: len(seen) > 5, on_step=seen.append)
    assert list(steps) == ["confidence_filter", "median_smooth"]
    drone = workflow.postprocess_chain(df, Raster(12, 12, 0.9), {}, 0.9)
    assert list(drone) == ["confidence_filter", "smooth_pass_0", "smooth_pass_1", "morphological_close_0", "morphological_close", "sieve_filter"]


def test_exact_quantiles(spark):
    for values in (RNG.random(1000), np.repeat([1.0, 2.0, 5.0], 40), np.array([3.0]), np.array([0.0, 1e300, -1e-300, 7.0]), RNG.normal(size=501) * 1e6):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        points = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
        got = stats.exact_quantiles(df, "v", points, 16)
        assert np.allclose(got, np.quantile(values, points), rtol=1e-12)
    assert stats.exact_quantiles(df.where("v is null"), "v", [0.5]) == [None]
    assert stats.confidence_stats(df.where("v is null"), "v").first().p50 is None


def test_layers_are_kept_apart(spark):
    """Two rasters of one size in one table give what each gives on its own."""
    rows = [(r, c, float((r * 7 + c * 3) % 11 + 1), (r * 5 + c) % 3 if (r + c) % 6 else None) for r in range(9) for c in range(8)]
    schema = "row int, col int, x double, cls int"
    one = {"a": spark.createDataFrame(rows, schema), "b": spark.createDataFrame([(r, c, x * 100, None if v is None else (v + r // 4) % 3) for r, c, x, v in rows], schema)}
    both = one["a"].withColumn("layer", F.lit("a")).unionByName(one["b"].withColumn("layer", F.lit("b")))
    operators = {
        "box": lambda p: preprocess.box_sums(p, {"s": F.col("x")}, 3),
        "dark": lambda p: preprocess.dos1(p, ["x"]),
        "lee": lambda p: preprocess.lee_filter(p, "x", 9, 8, 3),
        "terrain": lambda p: focal.roughness(focal.terrain(p, "x", 10.0), "slope", 9, 8),
        "close": lambda p: focal.morphological_close(p, "cls", 9, 8, 3),
        "median": lambda p: focal.median_smooth(p, "cls", 9, 8, 3),
        "sieve": lambda p: components.sieve(p, "cls", 8, 4, 8, 4),
        "label": lambda p: components.label_components(p, "cls", 8, 4, 4),
        "thumb": lambda p: grid.overview(p, 9, 8, ["x"], 4),
        "larger": lambda p: grid.overview(p, 9, 8, ["x"], 18),
        "pyramid": lambda p: grid.pyramid(p, "x", (2, 4)),
        "complete": lambda p: grid.complete(p.where("row + col <> 5"), 9, 8),
    }
    told = lambda df, names: sorted((tuple(None if v is None else round(v, 6) for v in r) for r in df.select(*names).collect()), key=str)
    for name, f in operators.items():
        out = f(both)
        names = [c for c in out.columns if c != "layer"]
        for layer, own in one.items():
            assert told(out.where(F.col("layer") == layer), names) == told(f(own), names), (name, layer)
