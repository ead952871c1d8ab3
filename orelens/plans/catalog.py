"""Named queries over the driver's tables, each with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelens.functions import indices as ix
from orelens.functions.geodesy import to_degrees, to_projected
from orelens.model import DEFAULTS, Raster
from orelens.operators import accuracy, components, coregister, focal, gates, grid, ml, preprocess, report, sampling, stats, synthetic, texture, validate, workflow
from orelens.sources import audit, export, ingest

from . import grids as g
from . import planner

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def rounded(df: DataFrame, *exact: str) -> DataFrame:
    """Every DOUBLE column to six decimals."""
    return df.select(*[r6(F.col(c), c) if kind == "double" and c not in exact else F.col(c) for c, kind in df.dtypes])


def quick6(c, name: str):
    """A DOUBLE of 0 or more to six decimals, halves up, in plain arithmetic as SQL does it: F.round makes a decimal of each."""
    y = c * 1e6
    return ((F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)) / 1e6).alias(name)


# --- projections -----------------------------------------------------------------------------------------------

_SQL_INDEX = {
    "ndvi": "(nir - red) / nullif(nir + red, 0)",
    "ndwi": "(green - nir) / nullif(green + nir, 0)",
    "bsi": "((swir + red) - (nir + blue)) / nullif((swir + red) + (nir + blue), 0)",
    "ndre": "(rededge - red) / nullif(rededge + red, 0)",
    "vari": "(green - red) / nullif(green + red - blue, 0)",
    "sar_ratio": "vv / nullif(vh, 0)",
    "iron_oxide": "red / nullif(blue, 0)",
    "clay_index": "swir / nullif(nir, 0)",
    "ferrous": "nir / nullif(swir, 0)",
    "mndwi": "(green - swir) / nullif(green + swir, 0)",
    "exg": "2.0 * green - red - blue",
    "exr": "1.4 * red - green",
    "brightness": "(red + green + blue) / 3.0",
    "hue": """CASE WHEN red IS NULL OR green IS NULL OR blue IS NULL THEN NULL
      WHEN greatest(red, green, blue) - least(red, green, blue) <= 1e-9 THEN 0.0
      WHEN blue >= red AND blue >= green THEN (60.0 * (red - green) / (blue - least(red, green, blue)) + 240.0) / 360.0
      WHEN green >= red THEN (60.0 * (blue - red) / (green - least(red, green, blue)) + 120.0) / 360.0
      ELSE (60.0 * (green - blue) / (red - least(red, green, blue)) + CASE WHEN green < blue THEN 360.0 ELSE 0.0 END) / 360.0 END""",
    "saturation": """CASE WHEN red IS NULL OR green IS NULL OR blue IS NULL THEN NULL
      WHEN greatest(red, green, blue) > 1e-9 THEN (greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue) ELSE 0.0 END""",
}


def _index_query(name: str):
    function, roles = ix.INDICES[name]

    def run(spark, sf_dir):
        return g.bands(spark, sf_dir).select("row", "col", r6(function(*map(F.col, roles)), "value"))

    query(f"WITH {g.BANDS_SQL} SELECT row, col, round({_SQL_INDEX[name]}, 6) AS value FROM b", name)(run)


for _name in _SQL_INDEX:
    _index_query(_name)


@query(f"WITH {g.BANDS_SQL} SELECT row, col, round(CASE WHEN vv / nullif(vh, 0) > 0 THEN 10 * log10(vv / vh) END, 6) AS value FROM b")
def sar_ratio_db(spark, sf_dir):
    return g.bands(spark, sf_dir).select("row", "col", r6(ix.sar_ratio(F.col("vv"), F.col("vh"), True), "value"))


@query(f"WITH {g.BANDS_SQL} SELECT row, col, round((nir - red) / nullif(nir + red, 0), 6) AS v, round(2.0 * green - red - blue, 6) AS x FROM b")
def sql_functions(spark, sf_dir):
    """Indices called from SQL text."""
    ix.register_sql_functions(spark)
    g.bands(spark, sf_dir).createOrReplaceTempView("orelens_bands")
    return spark.sql("SELECT row, col, round(ndvi(nir, red), 6) AS v, round(exg(green, red, blue), 6) AS x FROM orelens_bands")


@query(f"WITH {g.BANDS_SQL} SELECT row, col, round(coalesce((nir - red) / nullif(nir - red, 0), -1.0), 6) AS value FROM b")
def safe_ratio(spark, sf_dir):
    x = F.col("nir") - F.col("red")
    return g.bands(spark, sf_dir).select("row", "col", r6(ix.safe_ratio(x, x, -1.0), "value"))


@query(f"WITH {g.BANDS_SQL} SELECT row, col, round(red * 200 / 255.0, 6) AS value FROM b")
def uint8_scale(spark, sf_dir):
    return g.bands(spark, sf_dir).select("row", "col", r6(ix.scale_uint8(F.col("red") * 200), "value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders")
def from_sentinel(spark, sf_dir):
    """Sentinel, NaN and infinity become NULL."""
    raw = F.when(F.col("o_totalprice") > 400000, -9999.0).when(F.col("o_orderkey") % 11 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("o_totalprice"))
    return g.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), grid.from_sentinel(raw, -9999.0).alias("value"))


_NEW_FEATURES = ("ndvi", "ndwi", "bsi", "ndre", "vari", "sar_ratio", "iron_oxide", "clay_index", "ferrous", "mndwi", "exg", "exr", "brightness", "saturation")


@query(f"WITH {g.BANDS_SQL} SELECT row, col, " + ", ".join(f"round({_SQL_INDEX[n]}, 6) AS {n}" for n in _NEW_FEATURES) + " FROM b")
def feature_stack(spark, sf_dir):
    """What the planner makes of the band map, as one projection."""
    pixels = g.bands(spark, sf_dir).drop("dem")
    h = g.height(spark, sf_dir, "embeddings", g.BAND_WIDTH)
    stack, names = workflow.feature_stack(pixels, g.BAND_MAP, Raster(g.BAND_WIDTH, h, g.RES), {"mining_features_enabled": True}, _NEW_FEATURES)
    return rounded(stack)


# --- statistics ------------------------------------------------------------------------------------------------

_FEATURES = ("ndvi", "ndwi", "iron_oxide", "brightness")
_FEATURE_SQL = f"{g.BANDS_SQL}, f AS (SELECT row, col, label, " + ", ".join(f"{_SQL_INDEX[n]} AS {n}" for n in _FEATURES) + " FROM b)"


def _features(spark, sf_dir) -> DataFrame:
    made = [ix.INDICES[n][0](*map(F.col, ix.INDICES[n][1])).alias(n) for n in _FEATURES]
    return g.bands(spark, sf_dir).select("row", "col", "label", *made)


@query(f"WITH {_FEATURE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(coalesce(min({n}), 0), 6) AS min, round(coalesce(max({n}), 0), 6) AS max, round(coalesce(avg({n}), 0), 6) AS mean, round(coalesce(stddev_pop({n}), 0), 6) AS std, round(100.0 * count({n}) / count(*), 6) AS valid_pct FROM f" for n in _FEATURES))
def feature_stats(spark, sf_dir):
    return rounded(stats.feature_stats(_features(spark, sf_dir), list(_FEATURES)))


_PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({'1.0' if a == b else f'corr({a}, {b})'}, 6) AS r FROM v" for a in _FEATURES for b in _FEATURES)
_VALID_SQL = f"{_FEATURE_SQL}, v AS (SELECT * FROM f WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in _FEATURES) + ")"


@query(f"WITH {_VALID_SQL} SELECT a, b, r FROM ({_PAIR_SQL}) GROUP BY a, b, r")
def feature_correlation(spark, sf_dir):
    return rounded(stats.correlation(_features(spark, sf_dir), list(_FEATURES)))


@query(f"WITH {_VALID_SQL} SELECT a, b, r FROM ({_PAIR_SQL}) WHERE a < b AND abs(r) > 0.3 GROUP BY a, b, r")
def high_corr_pairs(spark, sf_dir):
    return rounded(stats.high_correlations(stats.correlation(_features(spark, sf_dir), list(_FEATURES)), 0.3))


_AREAS_SQL = f"{g.CLASSES_SQL}, a AS (SELECT cls AS class_id, count(*) AS pixel_count, count(*) * {g.RES * g.RES} / 10000.0 AS area_ha FROM c WHERE cls IS NOT NULL GROUP BY cls)"


@query(f"WITH {_AREAS_SQL} SELECT class_id, pixel_count, round(area_ha, 6) AS area_ha, round(100.0 * area_ha / sum(area_ha) OVER (), 6) AS area_pct FROM a")
def class_areas(spark, sf_dir):
    return rounded(stats.class_areas(g.classes(spark, sf_dir), "cls", g.RES))


@query(f"WITH {_AREAS_SQL} SELECT round(1 - sum(pixel_count) / (SELECT count(*) FROM events), 6) AS nodata_fraction FROM a")
def nodata_fraction(spark, sf_dir):
    h = g.height(spark, sf_dir, "events", g.CLASS_WIDTH)
    return rounded(stats.nodata_fraction(stats.class_areas(g.classes(spark, sf_dir), "cls", g.RES), h, g.CLASS_WIDTH))


@query(f"""WITH {g.CLASSES_SQL} SELECT round(avg(conf), 6) AS mean, round(min(conf), 6) AS min, round(max(conf), 6) AS max,
  round(quantile_cont(conf, 0.05), 6) AS p05, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.95), 6) AS p95,
  count(*) AS n_valid, count(*) FILTER (conf >= 0.6) AS n_above, round(100.0 * count(*) FILTER (conf >= 0.6) / count(*), 6) AS pct_above,
  count(*) FILTER (conf < 0.6) AS n_below, round(100.0 * count(*) FILTER (conf < 0.6) / count(*), 6) AS pct_below FROM c WHERE conf >= 0""")
def confidence_stats(spark, sf_dir):
    return rounded(stats.confidence_stats(g.classes(spark, sf_dir), "conf"))


@query(f"WITH {g.CLASSES_SQL} SELECT cls AS class, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percentage FROM c WHERE cls IS NOT NULL GROUP BY cls")
def class_summary(spark, sf_dir):
    return stats.class_summary(g.classes(spark, sf_dir).where("cls is not null"), "cls")


@query(f"WITH {g.CLASSES_SQL} SELECT bool_or(p < 20) AS imbalanced FROM (SELECT 100.0 * count(*) / sum(count(*)) OVER () AS p FROM c WHERE cls IS NOT NULL GROUP BY cls)")
def imbalance(spark, sf_dir):
    return stats.is_imbalanced(g.classes(spark, sf_dir).where("cls is not null"), "cls", 20.0)


_DRIFT_SQL = f"""{g.CLASSES_SQL},
  now AS (SELECT cls AS class_id, count(*) * 0.01 AS area_ha FROM c WHERE cls IS NOT NULL GROUP BY cls),
  was AS (SELECT class_id, CASE WHEN class_id = 2 THEN 0 ELSE count(*) * 0.01 END AS area_ha FROM (SELECT CASE WHEN conf < 0.1 THEN cls % 3 + 1 ELSE cls END AS class_id FROM c WHERE cls IS NOT NULL) GROUP BY class_id)"""


@query(f"""WITH {_DRIFT_SQL}, j AS (SELECT class_id, now.area_ha AS n, was.area_ha AS w FROM now JOIN was USING (class_id)),
  p AS (SELECT class_id, round(CASE WHEN w <> 0 THEN (n - w) / w * 100 WHEN n = 0 THEN 0 END, 6) AS pct_change, w = 0 AND n > 0 AS is_new FROM j)
  SELECT *, is_new OR coalesce(abs(pct_change) >= 20.0, false) AS flagged FROM p""")
def drift(spark, sf_dir):
    """Against an earlier run in which doubtful pixels had other classes and one class had no area."""
    now = g.classes(spark, sf_dir)
    then = now.withColumn("cls", F.when(F.col("conf") < 0.1, F.col("cls") % 3 + 1).otherwise(F.col("cls")))
    was = stats.class_areas(then, "cls", g.RES).withColumn("area_ha", F.when(F.col("class_id") == 2, 0.0).otherwise(F.col("area_ha")))
    return rounded(stats.drift(stats.class_areas(now, "cls", g.RES), was))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, round(s_acctbal * s_acctbal * 0.01, 6) AS hectares FROM supplier")
def pixel_hectares(spark, sf_dir):
    return g.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), r6(ix.hectares(F.col("s_acctbal") * F.col("s_acctbal"), 10.0), "hectares"))


@query("SELECT round(avg(l_discount), 6) AS shift_x, round(avg(l_tax), 6) AS shift_y, round(sqrt(avg(l_discount) ** 2 + avg(l_tax) ** 2), 6) AS shift_magnitude, round(avg(sqrt(l_discount ** 2 + l_tax ** 2)), 6) AS rmse FROM lineitem")
def coreg_shift_stats(spark, sf_dir):
    points = g.read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x_shift"), F.col("l_tax").alias("y_shift"), F.hypot("l_discount", "l_tax").alias("abs_shift"))
    return rounded(stats.shift_stats(points))


# --- preprocessing ---------------------------------------------------------------------------------------------


@query(f"WITH {g.BANDS_SQL} SELECT " + ", ".join(f"round(coalesce(min(CASE WHEN {n} > 0 THEN {n} END), 0), 6) AS {n}" for n in ("blue", "green", "red")) + " FROM b")
def dos1_dark_values(spark, sf_dir):
    return rounded(preprocess.dark_object_values(g.bands(spark, sf_dir), ["blue", "green", "red"]))


@query(f"WITH {g.BANDS_SQL}, m AS (SELECT " + ", ".join(f"coalesce(min(CASE WHEN {n} > 0 THEN {n} END), 0) AS d_{n}" for n in ("blue", "red")) + " FROM b) SELECT row, col, " + ", ".join(f"round(CASE WHEN {n} IS NOT NULL THEN least(greatest({n} - d_{n}, 0), 255) END, 6) AS {n}" for n in ("blue", "red")) + " FROM b, m")
def dos1_corrected(spark, sf_dir):
    return rounded(preprocess.dos1(g.bands(spark, sf_dir).select("row", "col", "blue", "red"), ["blue", "red"], "uint8"))


@query(f"WITH {g.DEM_SQL} SELECT round(CASE WHEN avg(dem) > 0 THEN avg(dem) ELSE 1 END, 6) AS dem FROM d WHERE (row // 16) * 7 + col // 16 < 4")
def band_means(spark, sf_dir):
    return rounded(preprocess.band_means(g.dem(spark, sf_dir), ["dem"], g.DEM_WIDTH, 16))


@query(f"WITH {g.DEM_SQL}, r AS (SELECT row, col, sum(coalesce(dem, 0)) OVER (PARTITION BY row ORDER BY col) AS s FROM d) SELECT row, col, round(sum(s) OVER (PARTITION BY col ORDER BY row), 6) AS integral FROM r")
def integral_image(spark, sf_dir):
    filled = g.dem(spark, sf_dir).na.fill(0.0, ["dem"])
    return preprocess.integral_image(filled, "dem").select("row", "col", r6("integral", "integral"))


def _around(cte: str, table: str, p: int, width: int, mode: str, columns: str) -> str:
    """SQL of (row, col, columns of each of the cells around), with the border's mode; needs `size` (h)."""
    fold = {
        "clip": lambda x, n: x,
        "nearest": lambda x, n: f"least(greatest({x}, 0), {n} - 1)",
        "mirror": lambda x, n: f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > {n} - 1 THEN 2 * ({n} - 1) - ({x}) ELSE {x} END",
        "symmetric": lambda x, n: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} > {n} - 1 THEN 2 * {n} - 1 - ({x}) ELSE {x} END",
    }[mode]
    return f"""WITH {cte}, size AS (SELECT max(row) + 1 AS h FROM {table}),
      o AS (SELECT i, j FROM range({-p}, {p + 1}) a(i), range({-p}, {p + 1}) b(j)),
      n AS (SELECT t.row, t.col, {fold("t.row + o.i", "h")} AS r2, {fold("t.col + o.j", str(width))} AS c2 FROM {table} t, o, size),
      w AS (SELECT n.row, n.col, {columns} FROM n JOIN {table} s ON s.row = n.r2 AND s.col = n.c2)"""


@query(_around(g.DEM_SQL, "d", 1, g.DEM_WIDTH, "clip", "s.dem AS v") + " SELECT row, col, round(sum(v), 6) AS total FROM w GROUP BY row, col")
def box_sum(spark, sf_dir):
    return preprocess.box_sums(g.dem(spark, sf_dir), {"total": F.col("dem")}, 3).select("row", "col", r6("total", "total"))


_MEAN_VAR = _around(g.DEM_SQL.replace("d AS (", "d0 AS (") + ", d AS (SELECT row, col, coalesce(dem, 0) AS dem FROM d0)", "d", 2, g.DEM_WIDTH, "mirror", "s.dem AS v")


@query(_MEAN_VAR + " SELECT row, col, round(sum(v) / 25, 6) AS mean, round(greatest(sum(v * v) / 25 - (sum(v) / 25) ** 2, 0), 3) AS var FROM w GROUP BY row, col")
def local_mean_var(spark, sf_dir):
    h = g.height(spark, sf_dir, "orders", g.DEM_WIDTH)
    out = preprocess.local_mean_var(g.dem(spark, sf_dir).na.fill(0.0, ["dem"]), "dem", 5, h, g.DEM_WIDTH)
    return out.select("row", "col", r6("mean", "mean"), F.round("var", 3).alias("var"))


_LEE = _around(
    g.DEM_SQL.replace("d AS (", "d0 AS (") + ", m AS (SELECT avg(dem) AS m FROM d0 WHERE (row // 16) * 7 + col // 16 < 4), d AS (SELECT row, col, dem AS raw, coalesce(dem, m) AS x FROM d0, m)",
    "d", 2, g.DEM_WIDTH, "mirror", "s.x AS v",
)


@query(_LEE + """, s AS (SELECT row, col, sum(v) / 25 AS mean, greatest(sum(v * v) / 25 - (sum(v) / 25) ** 2, 0) AS var FROM w GROUP BY row, col)
  SELECT d.row, d.col, round(CASE WHEN raw IS NOT NULL THEN mean + var / (var + (mean / 4.9) ** 2) * (x - mean) END, 4) AS dem FROM d JOIN s ON d.row = s.row AND d.col = s.col""")
def lee_filter(spark, sf_dir):
    h = g.height(spark, sf_dir, "orders", g.DEM_WIDTH)
    return preprocess.lee_filter(g.dem(spark, sf_dir), "dem", h, g.DEM_WIDTH, 5, 4.9, 16).select("row", "col", F.round("dem", 4).alias("dem"))


# --- neighbourhoods --------------------------------------------------------------------------------------------

_TERRAIN = f"""WITH {g.DEM_SQL}, q AS (
    SELECT row, col, dem, lag(dem) OVER r AS w, lead(dem) OVER r AS e, lag(dem) OVER c AS n, lead(dem) OVER c AS s,
           lag(1) OVER r IS NULL AS w0, lead(1) OVER r IS NULL AS e0, lag(1) OVER c IS NULL AS n0, lead(1) OVER c IS NULL AS s0
    FROM d WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)),
  t AS (SELECT row, col, dem, CASE WHEN w0 THEN (e - dem) / 10 WHEN e0 THEN (dem - w) / 10 ELSE (e - w) / 20 END AS dx,
               CASE WHEN n0 THEN (s - dem) / 10 WHEN s0 THEN (dem - n) / 10 ELSE (s - n) / 20 END AS dy FROM q)"""


@query(_TERRAIN + " SELECT row, col, round(CASE WHEN dem IS NOT NULL THEN sqrt(dx * dx + dy * dy) END, 6) AS slope FROM t")
def slope(spark, sf_dir):
    return rounded(focal.terrain(g.dem(spark, sf_dir), "dem", g.RES).select("row", "col", "slope"))


@query(_TERRAIN + " SELECT row, col, round(CASE WHEN dem IS NOT NULL THEN CASE WHEN degrees(atan2(-dy, dx)) < 0 THEN degrees(atan2(-dy, dx)) + 360 ELSE degrees(atan2(-dy, dx)) END END, 6) AS aspect FROM t")
def aspect(spark, sf_dir):
    return rounded(focal.terrain(g.dem(spark, sf_dir), "dem", g.RES).select("row", "col", "aspect"))


@query(_around(_TERRAIN.removeprefix("WITH ") + ", p AS (SELECT row, col, CASE WHEN dem IS NOT NULL THEN sqrt(dx * dx + dy * dy) END AS slope FROM t)", "p", 1, g.DEM_WIDTH, "nearest", "s.slope AS v")
  + " SELECT p.row, p.col, round(CASE WHEN any_value(p.slope) IS NOT NULL THEN stddev_pop(v) END, 5) AS roughness_proxy FROM p JOIN w ON p.row = w.row AND p.col = w.col GROUP BY p.row, p.col")
def roughness(spark, sf_dir):
    h = g.height(spark, sf_dir, "orders", g.DEM_WIDTH)
    out = focal.roughness(focal.terrain(g.dem(spark, sf_dir), "dem", g.RES).select("row", "col", "slope"), "slope", h, g.DEM_WIDTH)
    return out.select("row", "col", F.round("roughness_proxy", 5).alias("roughness_proxy"))


def _median_sql(k: int) -> str:
    return _around(g.CLASSES_SQL, "c", k // 2, g.CLASS_WIDTH, "symmetric", "coalesce(s.cls, -1) AS v") + f", m AS (SELECT row, col, list_sort(list(v))[{k * k // 2 + 1}] AS median FROM w GROUP BY row, col)"


def _majority_ctes(source: str, out: str, k: int) -> str:
    p, w = k // 2, g.CLASS_WIDTH
    return f"""{out}_n AS (SELECT t.row, t.col, s.cls AS v FROM {source} t, range({-p}, {p + 1}) a(i), range({-p}, {p + 1}) b(j), size
        JOIN {source} s ON s.row = least(greatest(t.row + a.i, 0), h - 1) AND s.col = least(greatest(t.col + b.j, 0), {w - 1}) WHERE s.cls IS NOT NULL),
      {out}_v AS (SELECT row, col, v, row_number() OVER (PARTITION BY row, col ORDER BY count(*) DESC, v) AS rank FROM {out}_n GROUP BY row, col, v),
      {out} AS (SELECT t.row, t.col, CASE WHEN t.cls IS NOT NULL THEN v END AS cls FROM {source} t LEFT JOIN {out}_v x ON t.row = x.row AND t.col = x.col AND rank = 1)"""


_SIZE_SQL = f"WITH {g.CLASSES_SQL}, size AS (SELECT max(row) + 1 AS h FROM c)"


def _class_grid(spark, sf_dir):
    return g.classes(spark, sf_dir), g.height(spark, sf_dir, "events", g.CLASS_WIDTH), g.CLASS_WIDTH


@query(_median_sql(3) + " SELECT row, col, CASE WHEN c.cls IS NOT NULL THEN median END AS cls FROM c JOIN m USING (row, col)")
def median_smooth(spark, sf_dir):
    c, h, w = _class_grid(spark, sf_dir)
    return focal.median_smooth(c, "cls", h, w, 3).select("row", "col", "cls")


@query(_median_sql(5) + " SELECT row, col, CASE WHEN c.cls IS NOT NULL AND conf >= 0 AND conf < 0.6 THEN median ELSE c.cls END AS cls FROM c JOIN m USING (row, col)")
def confidence_filter(spark, sf_dir):
    c, h, w = _class_grid(spark, sf_dir)
    return focal.confidence_filter(c, "cls", "conf", h, w, 0.6, 5).select("row", "col", "cls")


@query(f"{_SIZE_SQL}, {_majority_ctes('c', 'm', 3)} SELECT row, col, cls FROM m")
def majority_filter(spark, sf_dir):
    c, h, w = _class_grid(spark, sf_dir)
    return focal.majority_filter(c, "cls", h, w, 3).select("row", "col", "cls")


@query(f"{_SIZE_SQL}, {_majority_ctes('c', 'm', 7)} SELECT row, col, cls FROM m")
def majority_smooth(spark, sf_dir):
    c, h, w = _class_grid(spark, sf_dir)
    return focal.majority_smooth(c, "cls", h, w, 7).select("row", "col", "cls")


@query(f"{_SIZE_SQL}, {_majority_ctes('c', 'm1', 3)}, {_majority_ctes('m1', 'm2', 3)} SELECT row, col, cls FROM m2")
def morphological_close(spark, sf_dir):
    c, h, w = _class_grid(spark, sf_dir)
    return focal.morphological_close(c, "cls", h, w, 3).select("row", "col", "cls")


# --- texture ---------------------------------------------------------------------------------------------------

_B = 20


def _q_sql(levels: int) -> str:
    return f"""{g.DEM_SQL}, t AS (SELECT row // {_B} AS tile_r, col // {_B} AS tile_c, row, col, dem FROM d),
      k AS (SELECT tile_r, tile_c, min(dem) AS lo, max(dem) AS hi, avg(dem) AS mean FROM t GROUP BY 1, 2 HAVING max(dem) > min(dem)),
      q AS (SELECT tile_r, tile_c, row, col, CAST(least(greatest(floor((coalesce(dem, mean) - lo) / (hi - lo) * {levels - 1}), 0), {levels - 1}) AS INTEGER) AS q FROM t JOIN k USING (tile_r, tile_c))"""


def _p_sql(angles: str) -> str:
    return f"""a AS (SELECT * FROM (VALUES {angles}) v(angle, dr, dc)),
      h AS (SELECT x.tile_r, x.tile_c, angle, x.q AS i, y.q AS j FROM q x JOIN a ON true JOIN q y ON y.tile_r = x.tile_r AND y.tile_c = x.tile_c AND y.row = x.row + dr AND y.col = x.col + dc),
      s AS (SELECT tile_r, tile_c, angle, i, j FROM h UNION ALL SELECT tile_r, tile_c, angle, j, i FROM h),
      p AS (SELECT tile_r, tile_c, angle, i, j, count(*) / sum(count(*)) OVER (PARTITION BY tile_r, tile_c, angle) AS p FROM s GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH {_q_sql(16)}, {_p_sql('(0, 0, 1)')} SELECT CAST(tile_r AS INTEGER) AS tile_r, CAST(tile_c AS INTEGER) AS tile_c, round(sum(p * (i - j) ** 2), 6) AS contrast, round(sum(p / (1 + abs(i - j))), 6) AS homogeneity, round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM p GROUP BY 1, 2")
def glcm_tile(spark, sf_dir):
    return rounded(texture.glcm_tile(texture.tiles_of(g.dem(spark, sf_dir), "dem", _B), "dem", 16))


@query(f"""WITH {_q_sql(32)}, {_p_sql('(0, 0, 1), (45, -1, 1), (90, -1, 0), (135, -1, -1)')},
  z AS (SELECT tile_r, tile_c, angle, sum(p * (i - j) ** 2) AS contrast, sum(p / (1 + (i - j) ** 2)) AS homogeneity,
               (sum(p * i * j) - sum(p * i) * sum(p * j)) / sqrt((sum(p * i * i) - sum(p * i) ** 2) * (sum(p * j * j) - sum(p * j) ** 2)) AS correlation FROM p GROUP BY 1, 2, 3),
  y AS (SELECT tile_r, tile_c, i, j, sum(p) / 4 AS m FROM p GROUP BY 1, 2, 3, 4),
  e AS (SELECT tile_r, tile_c, -sum(m * log2(m + 1e-12)) AS entropy FROM y GROUP BY 1, 2)
  SELECT CAST(tile_r AS INTEGER) AS tile_r, CAST(tile_c AS INTEGER) AS tile_c, round(avg(contrast), 6) AS contrast, round(avg(homogeneity), 6) AS homogeneity, round(avg(correlation), 6) AS correlation, round(any_value(entropy), 6) AS entropy
  FROM z JOIN e USING (tile_r, tile_c) GROUP BY 1, 2""")
def glcm_directional(spark, sf_dir):
    return rounded(texture.glcm_directional(texture.tiles_of(g.dem(spark, sf_dir), "dem", _B), "dem", 32))


@query(f"""WITH {_q_sql(16)}, {_p_sql('(0, 0, 1)')}, x AS (SELECT tile_r, tile_c, sum(p * (i - j) ** 2) AS contrast, sum(p / (1 + abs(i - j))) AS homogeneity, -sum(p * log2(p + 1e-12)) AS entropy FROM p GROUP BY 1, 2)
  """ + " UNION ALL ".join(f"SELECT '{c}' AS property, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, round(min({c}), 5) AS min, round(max({c}), 5) AS max FROM x" for c in ("contrast", "homogeneity", "entropy")))
def texture_summary(spark, sf_dir):
    out = texture.texture_summary(texture.glcm_tile(texture.tiles_of(g.dem(spark, sf_dir), "dem", _B), "dem", 16))
    return out.select("property", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


@query()
def glcm_features(spark, sf_dir):
    """Texture of tiles with halos, spread to their pixels."""
    h = g.height(spark, sf_dir, "embeddings", g.BAND_WIDTH)
    stack, _ = workflow.feature_stack(g.bands(spark, sf_dir), g.BAND_MAP, Raster(g.BAND_WIDTH, h, g.RES), {}, planner.GLCM, 16)
    return rounded(stack)


# --- accuracy --------------------------------------------------------------------------------------------------

_PAIRS_SQL = "x AS (SELECT CAST(l_linenumber % 4 AS INTEGER) AS t, CAST((l_linenumber + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) % 5 AS INTEGER) AS p FROM lineitem)"


def _pairs(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    pairs = g.read(spark, sf_dir, "lineitem").select((n % 4).cast("int").alias("true"), ((n + F.when(F.col("l_quantity") > 40, 1).otherwise(0)) % 5).cast("int").alias("pred"))
    return accuracy.confusion(pairs, "true", "pred")


_PER_CLASS_SQL = f"""WITH {_PAIRS_SQL}, k AS (SELECT t AS c FROM x UNION SELECT p FROM x),
  m AS (SELECT c AS class_id, (SELECT count(*) FROM x WHERE t = c AND p = c) AS h, (SELECT count(*) FROM x WHERE t = c) AS ts, (SELECT count(*) FROM x WHERE p = c) AS ps FROM k),
  z AS (SELECT class_id, round(coalesce(h / nullif(ps, 0), 0), 6) AS precision, round(coalesce(h / nullif(ts, 0), 0), 6) AS recall, round(coalesce(2.0 * h / nullif(ps + ts, 0), 0), 6) AS f1, ts AS support FROM m)"""


@query(f"WITH {_PAIRS_SQL} SELECT t AS true, " + ", ".join(f'count(*) FILTER (p = {k}) AS "{k}"' for k in range(5)) + " FROM x GROUP BY t")
def confusion_matrix(spark, sf_dir):
    return accuracy.confusion_matrix(_pairs(spark, sf_dir), list(range(5)))


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (t = p) / count(*) AS po FROM x),
  e AS (SELECT sum(a.n * b.n) AS rc FROM (SELECT t AS k, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY t) a JOIN (SELECT p AS k, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY p) b USING (k))
  SELECT round(po, 6) AS oa, round((po - rc / n / n) / (1 - rc / n / n), 6) AS kappa FROM s, e""")
def overall_accuracy(spark, sf_dir):
    return rounded(accuracy.overall(_pairs(spark, sf_dir)))


@query(_PER_CLASS_SQL + " SELECT * FROM z")
def per_class_metrics(spark, sf_dir):
    return rounded(accuracy.per_class(_pairs(spark, sf_dir)))


@query(_PER_CLASS_SQL + " SELECT coalesce(min(f1) FILTER (r > 1), 1) AS minority_f1 FROM (SELECT *, row_number() OVER (ORDER BY support DESC, class_id) AS r FROM z)")
def minority_f1(spark, sf_dir):
    return rounded(accuracy.minority_f1(accuracy.per_class(_pairs(spark, sf_dir))))


_POINT_RASTER = Raster(100, 100, 10.0, 500000.0, 5000200.0, 4326)


def _points(spark, sf_dir) -> DataFrame:
    """Events as reference points of a raster of degrees, some of them spoilt."""
    e, n = g.read(spark, sf_dir, "events"), F.col("event_id")
    lat = F.when(n % 53 == 0, "").when(n % 59 == 0, "95").otherwise((50.0 - (n % 101) * 0.01 - 0.005).cast("string"))
    lon = F.when(n % 61 == 0, "x").otherwise((10.0 + (n * 7 % 100) * 0.01 + 0.005).cast("string"))
    return e.select(lat.alias("lat"), lon.alias("lon"), F.when(n % 67 == 0, "1.0").otherwise((n % 5 + 1).cast("string")).alias("class"))


_DEGREES = Raster(100, 100, 0.01, 10.0, 50.0, 4326)
_POINT_SQL = f"""{g.CLASSES_SQL}, pt AS (
  SELECT CASE WHEN event_id % 53 = 0 OR event_id % 61 = 0 OR event_id % 67 = 0 THEN 'missing_fields'
              WHEN event_id % 59 = 0 OR event_id % 101 = 100 THEN 'out_of_bounds' END AS reason,
         event_id % 101 AS row, event_id * 7 % 100 AS col, CAST(event_id % 5 + 1 AS INTEGER) AS t FROM events),
  j AS (SELECT t, cls AS p, coalesce(reason, CASE WHEN cls IS NULL THEN 'nodata_pixel' END) AS reason FROM pt LEFT JOIN c ON c.row = pt.row AND c.col = pt.col)"""


@query(f"WITH {_POINT_SQL} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def point_discards(spark, sf_dir):
    return accuracy.assess_points(_points(spark, sf_dir), g.classes(spark, sf_dir), "cls", _DEGREES)[1]


@query(f"WITH {_POINT_SQL} SELECT t AS true, p AS pred, count(*) AS n FROM j WHERE reason IS NULL GROUP BY t, p")
def point_sample(spark, sf_dir):
    return accuracy.confusion(accuracy.assess_points(_points(spark, sf_dir), g.classes(spark, sf_dir), "cls", _DEGREES)[0], "true", "pred")


# --- gates and validation --------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT * FROM (VALUES ('Overall Accuracy (training)', 0.85), ('Cohen''s Kappa', 0.80), ('Minority F1', 0.5), ('Mean Confidence', 0.59), ('Nodata Coverage', 0.05)) v(metric, value)),
  t AS (SELECT * FROM (VALUES (1, 'Overall Accuracy (training)', 0.9, 0.8, true), (2, 'Cohen''s Kappa', 0.8, 0.65, true), (3, 'Minority F1', 0.7, 0.5, true), (4, 'Overall Accuracy (independent)', 0.9, 0.8, true), (5, 'Mean Confidence', 0.75, 0.6, true), (6, 'Nodata Coverage', 0.05, 0.1, false)) v(gate, metric, p, f, up))
  SELECT gate, metric, CAST(value AS DOUBLE) AS value, CASE WHEN up THEN CASE WHEN value >= p THEN 'pass' WHEN value >= f THEN 'warning' ELSE 'fail' END ELSE CASE WHEN value <= p THEN 'pass' WHEN value <= f THEN 'warning' ELSE 'fail' END END AS status FROM m JOIN t USING (metric)""")
def quality_gates(spark, sf_dir):
    metrics = spark.createDataFrame([("Overall Accuracy (training)", 0.85), ("Cohen's Kappa", 0.80), ("Minority F1", 0.5), ("Overall Accuracy (independent)", None), ("Mean Confidence", 0.59), ("Nodata Coverage", 0.05)], "metric string, value double")
    return gates.quality_gates(metrics, gates.thresholds(spark, DEFAULTS)).select("gate", "metric", "value", "status")


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal >= 5000 THEN 'pass' WHEN s_acctbal >= 1000 THEN 'warning' ELSE 'fail' END AS status FROM supplier")
def gate_status(spark, sf_dir):
    s = g.read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), gates.status(F.col("s_acctbal"), F.lit(5000.0), F.lit(1000.0), F.lit(True)).alias("status"))


_ORDER_SQL = "m AS (SELECT o_orderkey AS id, (o_orderkey % 100) / 100.0 AS oa, (o_orderkey % 37) / 37.0 AS f1 FROM orders)"


@query(f"WITH {_ORDER_SQL} SELECT id, oa >= 0.8 AND f1 >= 0.7 AS gate_passed FROM m")
def legacy_gate(spark, sf_dir):
    o = g.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 100) / 100.0).alias("oa"), ((F.col("o_orderkey") % 37) / 37.0).alias("minority_f1"))
    return gates.legacy_gates(o, DEFAULTS).select("id", "gate_passed")


@query("SELECT o_orderkey AS id, (o_orderkey % 100) / 100.0 <= 0.5 AS gate_passed, CASE WHEN (o_orderkey % 100) / 100.0 <= 0.5 THEN 'a.tif' END AS corrected_path FROM orders")
def rmse_gate(spark, sf_dir):
    o = g.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 100) / 100.0).alias("rmse"), F.lit("a.tif").alias("corrected_path"), F.lit("").alias("message"))
    return gates.rmse_gate(o).select("id", "gate_passed", "corrected_path")


@query("SELECT metric, CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, passed FROM (VALUES ('Overall Accuracy', 0.85, 0.8, true), ('Cohen''s Kappa', 0.55, 0.6, false), ('Minority F1', 0.7, 0.7, true)) v(metric, value, threshold, passed)")
def report_gate(spark, sf_dir):
    return gates.report_gate(spark.createDataFrame([(0.85, 0.55, 0.7)], "oa double, kappa double, minority_f1 double"), DEFAULTS)


_LAYERS_SQL = """l AS (SELECT s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'sar' WHEN 1 THEN 'dem' WHEN 2 THEN 'optical' ELSE 'unknown' END AS layer_type,
  'EPSG:' || CAST(32630 + s_nationkey % 2 AS VARCHAR) AS crs, 10.0 + s_suppkey % 3 * 7 AS res, DATE '2024-01-01' + CAST(s_suppkey * 2 AS INTEGER) AS date,
  s_acctbal AS lft, 0.0 AS bottom, s_acctbal + 20000 AS rgt, 100.0 AS top, CAST(s_suppkey % 6 AS INTEGER) AS bands FROM supplier)"""


def _layers(spark, sf_dir) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_acctbal")
    kind = F.when(k % 4 == 0, "sar").when(k % 4 == 1, "dem").when(k % 4 == 2, "optical").otherwise("unknown")
    return g.read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), kind.alias("layer_type"), F.concat(F.lit("EPSG:"), (32630 + F.col("s_nationkey") % 2).cast("string")).alias("crs"),
        (10.0 + k % 3 * 7).alias("res"), F.date_add(F.lit("2024-01-01").cast("date"), (k * 2).cast("int")).alias("date"),
        n.alias("left"), F.lit(0.0).alias("bottom"), (n + 20000).alias("right"), F.lit(100.0).alias("top"), (k % 6).cast("int").alias("bands"),
    )


_PCT = "100.0 * (least(a.rgt, b.rgt) - greatest(a.lft, b.lft)) * 100 / (20000.0 * 100)"


@query(f"WITH {_LAYERS_SQL} SELECT 'crs_match' AS check, CASE WHEN count(*) < 2 THEN 'ok' WHEN count(*) > count(crs) OR count(DISTINCT crs) > 1 THEN 'error' ELSE 'ok' END AS status, count(DISTINCT crs) > 1 AS is_critical FROM l")
def crs_match(spark, sf_dir):
    return validate.crs_match(_layers(spark, sf_dir)).drop("message")


@query(f"WITH {_LAYERS_SQL} SELECT 'resolution_compatibility' AS check, CASE WHEN max(res) / min(res) > 2.0 THEN 'warn' ELSE 'ok' END AS status, false AS is_critical FROM l")
def resolution_compat(spark, sf_dir):
    return validate.resolution_compatibility(_layers(spark, sf_dir)).drop("message")


@query(f"WITH {_LAYERS_SQL} SELECT 'date_proximity' AS check, CASE WHEN count(date) < 2 OR max(date) - min(date) > 30 THEN 'warn' ELSE 'ok' END AS status, false AS is_critical FROM l")
def date_proximity(spark, sf_dir):
    return validate.date_proximity(_layers(spark, sf_dir)).drop("message")


@query(f"WITH {_LAYERS_SQL} SELECT 'phenology_risk' AS check, 'warn' AS status, false AS is_critical FROM l HAVING max(month(date)) - min(month(date)) > 2")
def phenology(spark, sf_dir):
    return validate.phenology_risk(_layers(spark, sf_dir)).drop("message")


@query(f"WITH {_LAYERS_SQL} SELECT a.name AS a, b.name AS b, round({_PCT}, 6) AS overlap_pct FROM l a JOIN l b ON a.name < b.name")
def overlap_pairs(spark, sf_dir):
    return validate.overlap_pairs(_layers(spark, sf_dir)).select("a", "b", quick6(F.col("overlap_pct"), "overlap_pct"))


@query(f"WITH {_LAYERS_SQL} SELECT 'minimum_overlap' AS check, CASE WHEN min({_PCT}) < 80 THEN 'error' ELSE 'ok' END AS status, min({_PCT}) < 80 AS is_critical FROM l a JOIN l b ON a.name < b.name")
def min_overlap(spark, sf_dir):
    return validate.minimum_overlap(_layers(spark, sf_dir)).drop("message")


@query(f"WITH {_LAYERS_SQL} SELECT 'band_count_' || name AS check, CASE WHEN layer_type = 'sar' AND bands NOT IN (1, 2, 4) OR layer_type = 'dem' AND bands <> 1 THEN 'warn' WHEN layer_type = 'optical' AND bands < 3 THEN 'error' ELSE 'ok' END AS status, false AS is_critical FROM l")
def band_counts(spark, sf_dir):
    return validate.band_counts(_layers(spark, sf_dir)).drop("message")


@query(f"""WITH {_LAYERS_SQL}, s AS (
    SELECT CASE WHEN layer_type = 'sar' AND bands NOT IN (1, 2, 4) OR layer_type = 'dem' AND bands <> 1 THEN 'warn' WHEN layer_type = 'optical' AND bands < 3 THEN 'error' ELSE 'ok' END AS status FROM l
    UNION ALL SELECT CASE WHEN count(DISTINCT crs) > 1 THEN 'error' ELSE 'ok' END FROM l
    UNION ALL SELECT CASE WHEN max(res) / min(res) > 2.0 THEN 'warn' ELSE 'ok' END FROM l
    UNION ALL SELECT CASE WHEN max(date) - min(date) > 30 THEN 'warn' ELSE 'ok' END FROM l
    UNION ALL SELECT 'warn' FROM l HAVING max(month(date)) - min(month(date)) > 2
    UNION ALL SELECT CASE WHEN min({_PCT}) < 80 THEN 'error' ELSE 'ok' END FROM l a JOIN l b ON a.name < b.name)
  SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'error') AS error FROM s""")
def validation_summary(spark, sf_dir):
    return validate.summary(validate.run_all(_layers(spark, sf_dir), DEFAULTS))


@query(f"WITH {_LAYERS_SQL} SELECT count(DISTINCT crs) > 1 OR (SELECT min({_PCT}) < 80 FROM l a JOIN l b ON a.name < b.name) AS blocked FROM l")
def critical_failures(spark, sf_dir):
    return validate.has_critical(validate.run_all(_layers(spark, sf_dir), DEFAULTS))


_ALIGN = [(None, 10.0, 100.0), ("EPSG:1", 10.0, 100.0), ("EPSG:2", 16.0, 100.0), ("EPSG:2", 10.0, 105.1), ("EPSG:2", 10.0, 105.0), ("EPSG:2", 15.0, 100.0)]


@query("SELECT 'label_alignment' AS check, status, status = 'error' AS is_critical, n FROM (VALUES ('error', 4), ('ok', 2)) v(status, n)")
def label_alignment(spark, sf_dir):
    rows = [((crs, res, x, 0.0), ("EPSG:2", 10.0, 100.0, 0.0)) for crs, res, x in _ALIGN]
    kind = "struct<crs:string,res:double,x:double,y:double>"
    out = validate.label_alignment(spark.createDataFrame(rows, f"label {kind}, feature {kind}"))
    return out.groupBy("check", "status", "is_critical").agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'shapefile_alignment' AS check, status, status = 'error' AS is_critical, n FROM (VALUES ('error', 3), ('ok', 1)) v(status, n)")
def shapefile_alignment(spark, sf_dir):
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [((None, *box, [1, 2]), ("EPSG:2", *box)), (("EPSG:1", 6.0, 0.0, 16.0, 10.0, [1, 2]), ("EPSG:2", *box)), (("EPSG:1", *box, [1]), ("EPSG:2", *box)), (("EPSG:1", 5.0, 0.0, 15.0, 10.0, [1, 2]), ("EPSG:2", *box))]
    sides = "left:double,bottom:double,right:double,top:double"
    out = validate.shapefile_alignment(spark.createDataFrame(rows, f"shape struct<crs:string,{sides},class_labels:array<int>>, feature struct<crs:string,{sides}>"))
    return out.groupBy("check", "status", "is_critical").agg(F.count("*").cast("int").alias("n"))


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 5 AS bands, p_size / 25.0 AS res, CASE WHEN p_size % 2 = 0 THEN 'uint8' ELSE 'float32' END AS dtype, p_size * 100000000.0 AS bytes FROM part)
  SELECT "check", status, count(*) AS n FROM (
    SELECT 'drone_band_count' AS check, CASE WHEN bands < 3 THEN 'error' ELSE 'ok' END AS status FROM r
    UNION ALL SELECT 'drone_resolution', CASE WHEN res >= 1 THEN 'warn' ELSE 'ok' END FROM r
    UNION ALL SELECT 'drone_band_scaling', CASE WHEN res < 1 AND dtype = 'uint8' THEN 'warn' ELSE 'ok' END FROM r
    UNION ALL SELECT 'drone_file_size', CASE WHEN bytes / 1073741824 > 2 THEN 'warn' ELSE 'ok' END FROM r
    UNION ALL SELECT 'drone_survey_area', 'ok' FROM r WHERE res > 0) GROUP BY 1, 2""")
def drone_inputs(spark, sf_dir):
    p = g.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") % 5).alias("bands"), F.when(F.col("p_size") % 2 == 0, "uint8").otherwise("float32").alias("dtype"), F.lit(100).alias("width"), F.lit(100).alias("height"), (F.col("p_size") / 25.0).alias("res"), F.lit(True).alias("projected"), (F.col("p_size") * 100000000.0).alias("file_bytes"))
    return validate.drone_inputs(p, {}).groupBy("check", "status").agg(F.count("*").alias("n"))


# --- ingestion -------------------------------------------------------------------------------------------------

_FILES_SQL = """f AS (SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN 'S1A_' WHEN 1 THEN 's2b_' WHEN 2 THEN 'LC08_' WHEN 3 THEN 'LC07_' WHEN 4 THEN 'site_DTM_' ELSE 'scene' END
  || CASE page_id % 3 WHEN 0 THEN '20240' || CAST(page_id % 9 + 1 AS VARCHAR) || '15' WHEN 1 THEN '2023-1' || CAST(page_id % 3 AS VARCHAR) || '-07' ELSE '20241399_x' END || '.tif' AS filename,
  CAST(page_id % 7 AS INTEGER) AS bands, CASE WHEN page_id % 8 = 5 THEN 'Elevation model' WHEN page_id % 8 = 6 THEN 'LANDSAT x' ELSE '' END AS said,
  CASE page_id % 5 WHEN 0 THEN '2022-03-04T05:06:07Z' WHEN 1 THEN 'nonsense' WHEN 2 THEN '20210102' ELSE '' END AS tagged FROM pages)"""


def _files(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    date = F.when(k % 3 == 0, F.concat(F.lit("20240"), (k % 9 + 1).cast("string"), F.lit("15"))).when(k % 3 == 1, F.concat(F.lit("2023-1"), (k % 3).cast("string"), F.lit("-07"))).otherwise("20241399_x")
    head = pick(8, "S1A_", "s2b_", "LC08_", "LC07_", "site_DTM_", "scene", "scene", "scene")
    tags = F.create_map(F.lit("DESCRIPTION"), pick(8, "", "", "", "", "", "Elevation model", "LANDSAT x", ""), F.lit("DATE_ACQUIRED"), pick(5, "2022-03-04T05:06:07Z", "nonsense", "20210102", "", ""))
    return g.read(spark, sf_dir, "pages").select(k.alias("id"), F.concat(head, date, F.lit(".tif")).alias("filename"), (k % 7).cast("int").alias("bands"), tags.alias("tags"))


_SENSOR_CASE = """CASE WHEN regexp_matches(filename, '(?i)S1[AB]_') THEN 'Sentinel-1' WHEN regexp_matches(filename, '(?i)S2[AB]_') THEN 'Sentinel-2' WHEN regexp_matches(filename, '(?i)LC0[89]_') THEN 'Landsat 8/9'
  WHEN regexp_matches(filename, '(?i)LC07_') THEN 'Landsat 7' WHEN regexp_matches(filename, '(?i)dem|dtm|dsm') THEN 'DEM' WHEN said LIKE 'Elevation%' THEN 'DEM' WHEN said LIKE 'LANDSAT%' THEN 'Landsat (unknown)'
  WHEN bands = 1 THEN 'Single-band (SAR or DEM)' WHEN bands IN (3, 4) THEN 'Multispectral RGB/RGBN' WHEN bands >= 5 THEN 'Multispectral / Hyperspectral' ELSE 'Unknown' END"""
_TYPE_CASE = "CASE WHEN sensor IN ('Sentinel-1', 'Single-band (SAR or DEM)') THEN 'sar' WHEN sensor = 'DEM' THEN 'dem' WHEN sensor = 'Unknown' THEN CASE WHEN bands = 1 THEN 'sar' ELSE 'unknown' END ELSE 'optical' END"


@query(f"WITH {_FILES_SQL} SELECT id, {_SENSOR_CASE} AS sensor FROM f")
def detect_sensor(spark, sf_dir):
    return _files(spark, sf_dir).select("id", ingest.sensor(F.col("filename"), F.col("bands"), F.col("tags")).alias("sensor"))


@query(f"WITH {_FILES_SQL}, s AS (SELECT *, {_SENSOR_CASE} AS sensor FROM f) SELECT id, {_TYPE_CASE} AS layer_type FROM s")
def layer_type(spark, sf_dir):
    return ingest.describe(_files(spark, sf_dir)).select("id", "layer_type")


_DATE_CASE = "CASE WHEN tagged LIKE '2022%' THEN DATE '2022-03-04' WHEN tagged = '20210102' THEN DATE '2021-01-02' WHEN id % 3 = 0 THEN CAST('2024-0' || CAST(id % 9 + 1 AS VARCHAR) || '-15' AS DATE) WHEN id % 3 = 1 THEN CAST('2023-1' || CAST(id % 3 AS VARCHAR) || '-07' AS DATE) END"


@query(f"WITH {_FILES_SQL} SELECT id, {_DATE_CASE} AS date FROM f")
def acquisition_date(spark, sf_dir):
    return ingest.describe(_files(spark, sf_dir)).select("id", "date")


@query(f"""WITH {_FILES_SQL}, s AS (SELECT *, {_SENSOR_CASE} AS sensor, {_DATE_CASE} AS d FROM f)
  SELECT 'layer' || CAST(id AS VARCHAR) AS layer_key, filename, sensor, {_TYPE_CASE} AS type, coalesce(CAST(d AS VARCHAR), 'Unknown') AS date,
         CASE WHEN id % 2 = 0 THEN 'EPSG:32633' WHEN id % 3 = 0 THEN 'LOCAL' ELSE 'No CRS' END AS crs, bands, 10 AS width_px, 20 AS height_px, '0.2500' AS gsd, CASE WHEN id % 2 = 0 THEN '-9999.0' ELSE 'None' END AS nodata FROM s""")
def metadata_table(spark, sf_dir):
    k = F.col("id")
    layers = ingest.describe(_files(spark, sf_dir)).select(F.concat(F.lit("layer"), k.cast("string")).alias("layer"), "filename", "sensor", "layer_type", "date", F.when(k % 2 == 0, 32633).alias("crs_epsg"), F.when(k % 3 == 0, "LOCAL").alias("crs"), "bands", F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit(-0.25).alias("res"), F.when(k % 2 == 0, -9999.0).alias("nodata"))
    return ingest.metadata_table(layers)


# --- tiles and overviews ---------------------------------------------------------------------------------------


def _untied(c: str):
    """To four decimals, moved off the halves that averages of few prices fall on."""
    return F.round(F.col(c) + 1.3e-8, 4).alias(c)


@query("""SELECT t AS tile, (t // 8) * 16 AS row_off, (t % 8) * 16 AS col_off, least(16, 100 - (t // 8) * 16) AS h, least(16, 120 - (t % 8) * 16) AS w FROM range(56) r(t)""")
def iter_windows(spark, sf_dir):
    return grid.windows(spark, 100, 120, 16)


@query(f"""WITH {g.DEM_SQL}, s AS (SELECT max(row) + 1 AS h FROM d), k AS (SELECT h, 40.0 / greatest(h, 100) AS f FROM s)
  SELECT CAST(floor(row * round(h * f) / h) AS INTEGER) AS row, CAST(floor(col * greatest(1, round(100 * f)) / 100) AS INTEGER) AS col, round(avg(dem) + 1.3e-8, 4) AS dem FROM d, k GROUP BY 1, 2""")
def read_overview(spark, sf_dir):
    h = g.height(spark, sf_dir, "orders", g.DEM_WIDTH)
    return grid.overview(g.dem(spark, sf_dir), h, g.DEM_WIDTH, ["dem"], 40).select("row", "col", _untied("dem"))


@query(f"WITH {g.DEM_SQL}, f AS (SELECT unnest([2, 4, 8, 16]) AS factor) SELECT CAST(factor AS INTEGER) AS factor, CAST(row // factor AS INTEGER) AS row, CAST(col // factor AS INTEGER) AS col, round(avg(dem) + 1.3e-8, 4) AS dem FROM d, f GROUP BY 1, 2, 3")
def overview_pyramid(spark, sf_dir):
    return grid.pyramid(g.dem(spark, sf_dir), "dem").withColumn("dem", _untied("dem"))


@query(f"WITH {g.CLASSES_SQL}, f AS (SELECT unnest([2, 4]) AS factor) SELECT CAST(factor AS INTEGER) AS factor, CAST(row // factor AS INTEGER) AS row, CAST(col // factor AS INTEGER) AS col, cls FROM c, f WHERE row % factor = 0 AND col % factor = 0")
def overview_classes(spark, sf_dir):
    filled = g.classes(spark, sf_dir).withColumn("cls", F.coalesce("cls", F.lit(-1)))
    return grid.pyramid(filled, "cls", (2, 4), True).withColumn("cls", F.when(F.col("cls") >= 0, F.col("cls")))


# --- samples ---------------------------------------------------------------------------------------------------

_POLYGONS = (
    (0, 1, [[(1.0, -1.0), (9.2, -1.0), (9.2, -8.7), (1.0, -8.7), (1.0, -1.0)]]),
    (1, 2, [[(5.0, -5.0), (20.0, -5.0), (12.0, -17.0), (5.0, -5.0)]]),
    (2, 3, [[(0.0, -12.0), (8.0, -12.0), (8.0, -20.0), (0.0, -20.0), (0.0, -12.0)], [(2.0, -14.0), (6.0, -14.0), (6.0, -18.0), (2.0, -18.0), (2.0, -14.0)]]),
)


def _polygons(spark) -> DataFrame:
    return spark.createDataFrame(list(_POLYGONS), "poly_id int, class_id int, rings array<array<struct<x:double,y:double>>>")


def _polygon_pixels(spark, sf_dir, most: int = 0) -> DataFrame:
    raster = Raster(g.BAND_WIDTH, g.height(spark, sf_dir, "embeddings", g.BAND_WIDTH), 1.0, 0.0, 0.0, 32633)
    return sampling.extract_from_polygons(g.bands(spark, sf_dir), _polygons(spark), ["red", "nir"], raster, most)


_EDGE_ROWS = ", ".join(f"({p}, {c}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for p, c, rings in _POLYGONS for ring in rings for a, b in zip(ring, ring[1:]))
_POLYGON_SQL = f"""{g.BANDS_SQL}, e AS (SELECT * FROM (VALUES {_EDGE_ROWS}) v(poly_id, class_id, x1, y1, x2, y2)),
  i AS (SELECT poly_id, class_id, row, col, count(*) FILTER ((y1 > -(row + 0.5)) <> (y2 > -(row + 0.5)) AND col + 0.5 < (x2 - x1) * (-(row + 0.5) - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside
        FROM b, e WHERE red IS NOT NULL GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_POLYGON_SQL} SELECT poly_id, row, col, class_id AS label FROM i WHERE inside")
def polygon_sample(spark, sf_dir):
    return _polygon_pixels(spark, sf_dir).select("poly_id", "row", "col", "label")


@query(f"WITH {_POLYGON_SQL} SELECT poly_id, least(count(*), 10) AS n FROM i WHERE inside GROUP BY poly_id")
def per_polygon_cap(spark, sf_dir):
    return _polygon_pixels(spark, sf_dir, 10).groupBy("poly_id").agg(F.count("*").alias("n"))


@query("SELECT 0.0::DOUBLE AS \"left\", -20.0::DOUBLE AS bottom, 20.0::DOUBLE AS \"right\", -1.0::DOUBLE AS top, [1, 2, 3] AS class_labels")
def polygon_meta(spark, sf_dir):
    return sampling.polygon_meta(_polygons(spark))


_SAMPLES_SQL = f"{_FEATURE_SQL}, s AS (SELECT f.*, label AS y FROM f WHERE label <> 0 AND " + " AND ".join(f"{n} IS NOT NULL" for n in _FEATURES) + ")"


@query(f"WITH {_SAMPLES_SQL} SELECT row, col, " + ", ".join(f"round({n}, 6) AS {n}" for n in _FEATURES) + ", CAST(y AS INTEGER) AS label FROM s")
def training_samples(spark, sf_dir):
    f = _features(spark, sf_dir)
    return rounded(sampling.extract_from_labels(f.drop("label"), f.select("row", "col", "label"), list(_FEATURES)))


@query(f"""WITH {_SAMPLES_SQL}, n AS (SELECT y AS label, count(*) AS n, sum(count(*)) OVER () AS t FROM s GROUP BY y)
  SELECT CAST(label AS INTEGER) AS label, CAST(CASE WHEN t <= 100 THEN n ELSE least(n, greatest(1, round_even(100 * n / t, 0))) END AS BIGINT) AS n FROM n""")
def stratified_subsample(spark, sf_dir):
    """Exact sizes; which rows are drawn is a matter of a hash."""
    f = _features(spark, sf_dir)
    out = sampling.extract_from_labels(f.drop("label"), f.select("row", "col", "label"), list(_FEATURES), most=100)
    return out.groupBy("label").agg(F.count("*").alias("n"))


# --- components and the chain ----------------------------------------------------------------------------------

def _component_sql(eight: bool) -> str:
    near = "true" if eight else "abs(i) + abs(j) <= 1"
    return f"""WITH RECURSIVE {g.CLASSES_SQL}, cell AS (SELECT row * {g.CLASS_WIDTH} + col AS id, row, col, cls FROM c WHERE cls IS NOT NULL),
      step AS (SELECT i, j FROM range(-1, 2) x(i), range(-1, 2) y(j) WHERE {near}),
      link AS (SELECT a.id AS a, b.id AS b FROM cell a JOIN step ON true JOIN cell b ON b.row = a.row + i AND b.col = a.col + j AND a.cls = b.cls),
      reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
      comp AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a)"""


@query(_component_sql(False) + " SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(cls AS BIGINT) AS cls, CAST(label AS BIGINT) AS label FROM cell JOIN comp USING (id)")
def components_4(spark, sf_dir):
    return components.label_components(g.classes(spark, sf_dir), "cls", g.CLASS_WIDTH, 4, 32)


@query(_component_sql(True) + " SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(cls AS BIGINT) AS cls, CAST(label AS BIGINT) AS label FROM cell JOIN comp USING (id)")
def components_8(spark, sf_dir):
    return components.label_components(g.classes(spark, sf_dir), "cls", g.CLASS_WIDTH, 8, 32)


@query(_component_sql(False) + """, size AS MATERIALIZED (SELECT label, count(*) AS n, any_value(cls) AS cls FROM comp JOIN cell USING (id) GROUP BY label),
  touch AS (SELECT DISTINCT x.label AS a, y.label AS b FROM cell a JOIN step ON abs(i) + abs(j) = 1 JOIN cell b ON b.row = a.row + i AND b.col = a.col + j JOIN comp x ON x.id = a.id JOIN comp y ON y.id = b.id WHERE x.label <> y.label),
  next AS MATERIALIZED (SELECT a AS label, b AS nb FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM touch JOIN size ON size.label = b) WHERE r = 1),
  hop(label, place, step) AS (SELECT label, label, 0 FROM size UNION ALL SELECT h.label, nx.nb, step + 1 FROM hop h JOIN size s ON s.label = h.place JOIN next nx ON nx.label = h.place WHERE s.n < 6 AND step < 64),
  ends AS (SELECT h.label, any_value(s.cls) AS cls FROM hop h JOIN size s ON s.label = h.place WHERE s.n >= 6 GROUP BY h.label)
  SELECT c.row, c.col, CASE WHEN c.cls IS NOT NULL THEN coalesce(ends.cls, c.cls) END AS cls FROM c LEFT JOIN comp ON comp.id = c.row * 100 + c.col LEFT JOIN ends ON ends.label = comp.label""")
def sieve(spark, sf_dir):
    return components.sieve(g.classes(spark, sf_dir).drop("conf"), "cls", g.CLASS_WIDTH, 6, 4, 32)


@query()
def postprocess_chain(spark, sf_dir):
    """All steps of the chain at 10 m, with the areas after each."""
    c, h, w = _class_grid(spark, sf_dir)
    steps = workflow.postprocess_chain(c, Raster(w, h, g.RES), DEFAULTS, g.RES)
    out = None
    for name, df in steps.items():
        one = stats.class_areas(df, "cls", g.RES).select(F.lit(name).alias("step"), "class_id", "pixel_count")
        out = one if out is None else out.unionByName(one)
    return out


# --- classification --------------------------------------------------------------------------------------------


def _train_set(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    names = ["blue", "green", "red", "nir"]
    b = g.bands(spark, sf_dir).na.drop(subset=names)
    return b.select("row", "col", *names, (F.col("label") % 2 + 1).cast("int").alias("label")), names


@query()
def rf_cv_metrics(spark, sf_dir):
    samples, names = _train_set(spark, sf_dir)
    r = ml.train(samples, names, ml.ClassificationConfig(n_estimators=10, k_folds=3, max_depth=5), DEFAULTS)
    return spark.createDataFrame([(float(r.oa), float(r.kappa), float(r.minority_f1), r.gate_passed, r.gate_message)], "oa double, kappa double, minority_f1 double, gate_passed boolean, gate_message string")


@query()
def gbt_predict(spark, sf_dir):
    samples, names = _train_set(spark, sf_dir)
    model = ml.fit(samples, names, ml.ClassificationConfig("xgboost", n_estimators=3, max_depth=3))
    return ml.predict(model, g.bands(spark, sf_dir)).select("row", "col", "cls", F.round("conf", 6).alias("conf"))


@query()
def ensemble_predict(spark, sf_dir):
    samples, names = _train_set(spark, sf_dir)
    model = ml.fit(samples, names, ml.ClassificationConfig("ensemble", n_estimators=5, max_depth=4))
    return ml.predict(model, g.bands(spark, sf_dir)).select("row", "col", "cls", F.round("conf", 6).alias("conf"))


@query()
def importances(spark, sf_dir):
    samples, names = _train_set(spark, sf_dir)
    model = ml.fit(samples, names, ml.ClassificationConfig(n_estimators=10, max_depth=5))
    return report.top_importances(spark.createDataFrame(sorted(model.importances().items()), "feature string, importance double"), 10)


@query(f"WITH {g.BANDS_SQL}, s AS (SELECT label % 10 < 2 AS rare FROM b WHERE red IS NOT NULL), n AS (SELECT rare, count(*) AS n FROM s GROUP BY rare) SELECT CAST(CASE WHEN rare THEN 2 ELSE 1 END AS INTEGER) AS label, (SELECT max(n) FROM n) AS n FROM n")
def smote(spark, sf_dir):
    """Classes after balancing: all as large as the largest."""
    names = ["red", "nir"]
    b = g.bands(spark, sf_dir).na.drop(subset=names).select(*names, F.when(F.col("label") % 10 < 2, 2).otherwise(1).alias("label"))
    return ml.smote(b, names).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {g.CLASSES_SQL} SELECT cls AS label, fold, CAST(count(*) // 5 + CASE WHEN fold < count(*) % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, range(5) f(fold) WHERE cls IS NOT NULL GROUP BY cls, fold".replace("fold,", "CAST(fold AS INTEGER) AS fold,", 1))
def stratified_folds(spark, sf_dir):
    """Folds of each class differ by one row at most."""
    c = g.classes(spark, sf_dir).where("cls is not null").withColumnRenamed("cls", "label")
    return ml.with_folds(c, "label", 5).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query()
def synthetic_labels(spark, sf_dir):
    """Pixels by class of the three synthetic sites."""
    sites = {"rings": synthetic.ring_labels, "pit": synthetic.pit_wall_labels, "tailings": synthetic.tailings_labels}
    parts = [make(spark, 120, 120).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(name).alias("site"), "label", "n") for name, make in sites.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_SAMPLES_SQL} SELECT 'Class ' || CAST(y AS VARCHAR) AS label, CAST(count(*) AS VARCHAR) AS value FROM s GROUP BY y")
def support_section(spark, sf_dir):
    """Samples by class as report rows."""
    f = _features(spark, sf_dir)
    samples = sampling.extract_from_labels(f.drop("label"), f.select("row", "col", "label"), list(_FEATURES))
    conf = accuracy.confusion(samples, "label", "label")
    return accuracy.per_class(conf).select(F.concat(F.lit("Class "), F.col("class_id").cast("string")).alias("label"), report.shown(F.col("support"), "bigint").alias("value"))


@query("SELECT * FROM (VALUES ('Minimum overlap (%)', '80.0'), ('Largest resolution ratio', '2.0'), ('Largest date gap (days)', '30'), ('Looks (radar default)', '1.0'), ('Looks (Sentinel-1 IW)', '4.9'), ('Least overall accuracy', '0.8'), ('Least minority F1', '0.7'), ('Largest coregistration RMSE (px)', '0.5'), ('Target reference system', 'N/A'), ('Pixel size (m)', 'N/A')) v(label, value)")
def configuration_section(spark, sf_dir):
    return spark.createDataFrame(report.configuration(DEFAULTS), "label string, value string")


@query("SELECT 'fail' AS gate_status, 3 AS gates")
def gate_summary(spark, sf_dir):
    """The worst status of a run's gates, as exported items carry it."""
    metrics = spark.createDataFrame([("Minority F1", 0.1), ("Mean Confidence", 0.7), ("Nodata Coverage", 0.01)], "metric string, value double")
    done = gates.quality_gates(metrics, gates.thresholds(spark, DEFAULTS))
    return gates.worst(done).select(F.col("status").alias("gate_status")).join(done.agg(F.count("*").cast("int").alias("gates")))


# --- planning, reports, exports --------------------------------------------------------------------------------


@query("SELECT CAST(res_m AS DOUBLE) AS res_m, CAST(ground_m AS DOUBLE) AS ground_m, kernel FROM (VALUES (10.0, 2.0, 3), (0.5, 2.0, 5), (0.1, 2.0, 21), (0.05, 2.0, 41), (0.01, 2.0, 51), (1.0, 4.0, 5)) v(res_m, ground_m, kernel)")
def adaptive_kernel(spark, sf_dir):
    cases = ((10.0, 2.0), (0.5, 2.0), (0.1, 2.0), (0.05, 2.0), (0.01, 2.0), (1.0, 4.0))
    return spark.createDataFrame([(a, b, planner.adaptive_kernel_size(a, b)) for a, b in cases], "res_m double, ground_m double, kernel int")


@query("SELECT * FROM (VALUES (0, 'confidence_filter'), (1, 'smooth_pass_0'), (2, 'smooth_pass_1'), (3, 'morphological_close'), (4, 'sieve_filter')) v(n, step)")
def chain_step_plan(spark, sf_dir):
    return spark.createDataFrame([(i, k) for i, (k, _) in enumerate(planner.chain_steps(0.05, DEFAULTS))], "n int, step string")


@query("SELECT step, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES ('confidence_filter', 0.8), ('median_smooth', 1.2), ('morphological_close', 0.6), ('sieve_filter', 0.4)) v(step, seconds)")
def chain_time(spark, sf_dir):
    return spark.createDataFrame([(k, round(v, 6)) for k, v in planner.estimate_chain_time(1_000_000, DEFAULTS, 10.0).items()], "step string, seconds double")


_NAMES_SQL = "n AS (SELECT CAST(n_nationkey AS INTEGER) AS class_id, n_name AS class_name FROM nation WHERE n_nationkey <> 3)"


@query(f"WITH {_AREAS_SQL}, {_NAMES_SQL} SELECT class_id, coalesce(class_name, 'Class ' || CAST(class_id AS VARCHAR)) AS class_name, pixel_count, round(area_ha, 2) AS area_ha, round(100.0 * area_ha / (SELECT sum(area_ha) FROM a), 1) AS area_pct FROM a LEFT JOIN n USING (class_id)")
def area_report(spark, sf_dir):
    names = g.read(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class_name"))
    return report.area_section(stats.class_areas(g.classes(spark, sf_dir), "cls", g.RES), names)


_METRICS = {"Overall accuracy": "0.9000", "Cohen's kappa": "N/A", "Minority F1": "0.8000", "Model type": "random_forest", "SMOTE applied": "No", "Overall accuracy (points)": "0.8800", "Cohen's kappa (points)": "0.8500"}
_METRICS_SQL = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v) for k, v in _METRICS.items()) + ") v(label, value)"


@query(f"WITH {_AREAS_SQL} {_METRICS_SQL} UNION ALL SELECT 'Total area (ha)', printf('%.4f', sum(area_ha)) FROM a UNION ALL SELECT 'Dominant class (%)', printf('%.4f', 100.0 * max(area_ha) / sum(area_ha)) FROM a UNION ALL SELECT 'Classes', CAST(count(*) AS VARCHAR) FROM a UNION ALL SELECT 'Classified pixels', CAST(CAST(sum(pixel_count) AS BIGINT) AS VARCHAR) FROM a UNION ALL SELECT 'Dominant class', CAST((SELECT class_id FROM a ORDER BY area_ha DESC, class_id LIMIT 1) AS VARCHAR) UNION ALL SELECT 'Quality gate passed', 'Yes'")
def executive_summary(spark, sf_dir):
    metrics = spark.createDataFrame([(0.9, None, 0.8, True, "random_forest", False, 0.88, 0.85)], "oa double, kappa double, minority_f1 double, gate_passed boolean, model_type string, smote_applied boolean, point_oa double, point_kappa double")
    return report.executive_summary(metrics, stats.class_areas(g.classes(spark, sf_dir), "cls", g.RES))


@query(f"""WITH {_AREAS_SQL}, {_NAMES_SQL}, k(class_id, colour) AS (VALUES {", ".join(str(kv) for kv in report.COLOURS.items())})
  SELECT class_id, class_name, coalesce(colour, '{report.OTHER_COLOUR}') AS colour, round(coalesce(area_ha, 0.0), 2) AS area_ha, round(coalesce(100.0 * area_ha / (SELECT sum(area_ha) FROM a), 0.0), 1) AS area_pct
  FROM n LEFT JOIN a USING (class_id) LEFT JOIN k USING (class_id)""")
def map_legend(spark, sf_dir):
    names = g.read(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class_name"))
    return report.legend_section(stats.class_areas(g.classes(spark, sf_dir), "cls", g.RES), names)


_EVENTS_SQL = "e AS (SELECT ts AS timestamp, CAST(user_id % 10 AS VARCHAR) AS run_id, event_type, props AS details FROM events)"


def _audit(spark, sf_dir) -> DataFrame:
    return g.read(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), (F.col("user_id") % 10).cast("string").alias("run_id"), "event_type", F.col("props").alias("details"), F.lit(None).cast("string").alias("decision"))


@query(f"WITH {_EVENTS_SQL} SELECT timestamp, event_type, '—' AS stage, '—' AS decision FROM e ORDER BY timestamp DESC, event_type LIMIT 50")
def audit_tail(spark, sf_dir):
    return report.audit_section(_audit(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL} SELECT DISTINCT run_id FROM e WHERE run_id NOT IN (SELECT run_id FROM e WHERE event_type = 'signup' AND details = '{{\"k\": 1}}')")
def config_snapshot(spark, sf_dir):
    """Runs whose configuration is still to be logged."""
    spoken = F.when((F.col("event_type") == "signup") & (F.col("details") == '{"k": 1}'), "config_snapshot").otherwise(F.col("event_type"))
    return audit.missing_snapshots(_audit(spark, sf_dir).withColumn("event_type", spoken))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def checksums(spark, sf_dir):
    d = g.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("""WITH r AS (SELECT s_name AS stem, s_suppkey % 50 + 1 AS w, s_suppkey % 40 + 1 AS h, s_suppkey % 90 AS x, s_suppkey % 45 AS y, CASE WHEN s_suppkey % 2 = 0 THEN 'int16' ELSE 'float32' END AS dtype FROM supplier)
  SELECT 'RUN1_' || stem AS id, 'Feature' AS type, CAST(x AS DOUBLE) AS west, CAST(y AS DOUBLE) AS south, x + w / 100.0::DOUBLE AS east, y + h / 100.0::DOUBLE AS north, 5 AS corners, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS width,
  4326 AS epsg, 'RUN1' AS run_id, dtype, CAST(-1 AS DOUBLE) AS nodata, 'pass' AS gate, '2020-02-03' AS acquired, '2024-01-01T00:00:00+00:00' AS stamp, stem AS title, stem || '.tif' AS href FROM r""")
def stac_item(spark, sf_dir):
    """Items of rasters in degrees, read back from their JSON."""
    from datetime import UTC, datetime

    n = lambda m: F.col("s_suppkey") % m
    w, h, x, y = (n(50) + 1).cast("int"), (n(40) + 1).cast("int"), n(90).cast("double"), n(45).cast("double")
    box = F.struct(x.alias("left"), y.alias("bottom"), (x + w / F.lit(100.0)).alias("right"), (y + h / F.lit(100.0)).alias("top"))
    rasters = g.read(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".tif")).alias("filename"), w.alias("width"), h.alias("height"), F.when(n(2) == 0, "int16").otherwise("float32").alias("dtype"), F.lit(-1.0).alias("nodata"), box.alias("bounds"))
    items = export.stac_items(rasters, "RUN1", 4326, {"gate": "pass", "datetime": "2020-02-03", "run_id": "other"}, datetime(2024, 1, 1, tzinfo=UTC))
    schema = "type string, bbox array<double>, geometry struct<coordinates:array<array<array<double>>>>, properties struct<datetime:string,run_id:string,`proj:epsg`:int,`proj:shape`:array<int>,nodata:double,dtype:string,gate:string,acquired:string>, assets struct<data:struct<href:string,title:string>>"
    i, p = F.col("i"), F.col("i.properties")
    return items.select("id", F.from_json("item", schema).alias("i")).select(
        "id", "i.type", *[i["bbox"][k].alias(c) for k, c in enumerate(("west", "south", "east", "north"))], F.size(i["geometry"]["coordinates"][0]).alias("corners"),
        p["proj:shape"][0].alias("height"), p["proj:shape"][1].alias("width"), p["proj:epsg"].alias("epsg"), p["run_id"].alias("run_id"), p["dtype"].alias("dtype"),
        p["nodata"].alias("nodata"), p["gate"].alias("gate"), p["acquired"].alias("acquired"), p["datetime"].alias("stamp"), "i.assets.data.title", "i.assets.data.href",
    )


@query("SELECT event_id AS id, CAST(event_id % 6 + 6 AS DOUBLE) AS lon, round(45.0::DOUBLE + event_id % 900 / 100.0, 7) AS lat FROM events")
def utm_round_trip(spark, sf_dir):
    """Degrees to UTM zone 32 and back."""
    n = F.col("event_id")
    x, y = to_projected((n % 6) - 3 + 9.0, 45.0 + n % 900 / 100.0, 32632)
    e = g.read(spark, sf_dir, "events").select(n.alias("id"), x.alias("x"), y.alias("y"))
    lon, lat = to_degrees(F.col("x"), F.col("y"), 32632)
    return e.select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("SELECT s_name AS layer, CASE WHEN s_suppkey % 3 = 0 THEN 'pre/' ELSE 'raw/' END || s_name AS path FROM supplier")
def candidate_sources(spark, sf_dir):
    s = g.read(spark, sf_dir, "supplier")
    raw = s.select(F.col("s_name").alias("layer"), F.concat(F.lit("raw/"), "s_name").alias("path"))
    pre = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("layer"), F.concat(F.lit("pre/"), "s_name").alias("path"))
    return report.candidate_sources(raw, pre)


@query(f"WITH {g.DEM_SQL}, q AS (SELECT quantile_cont(dem, 0.02) AS lo, quantile_cont(dem, 0.98) AS hi FROM d) SELECT row, col, round(CASE WHEN dem IS NOT NULL THEN greatest(0, least(1, (dem - lo) / (hi - lo))) END, 6) AS dem FROM d, q")
def preview_stretch(spark, sf_dir):
    return rounded(report.stretch(g.dem(spark, sf_dir), "dem"))


@query()
def coregister_shift(spark, sf_dir):
    """Phase correlation of a band with itself moved by two columns and a row."""
    d = g.dem(spark, sf_dir).na.fill(0.0)
    moved = d.select((F.col("row") + 1).alias("row"), (F.col("col") + 2).alias("col"), "dem")
    return coregister.shift_report(coregister.coregister(d, moved, "dem", "dem", "x.tif", 5.0))


@query(f"WITH {g.DEM_SQL} SELECT row, col, dem FROM d WHERE row >= 1 AND col < {g.DEM_WIDTH} - 2")
def coregister_corrected(spark, sf_dir):
    """A raster that was found two columns to the left of the reference and a row below it, moved back."""
    h = g.height(spark, sf_dir, "orders", g.DEM_WIDTH) + 1
    moved = g.dem(spark, sf_dir).where(f"row >= 1 and col < {g.DEM_WIDTH - 2}").select((F.col("row") + 1).alias("row"), (F.col("col") - 2).alias("col"), "dem")
    found = spark.createDataFrame([(-2.2, 0.9)], "shift_x double, shift_y double")
    return coregister.corrected(moved, found, h, g.DEM_WIDTH)


@query(ORACLE_SQL["confidence_filter"])
def joined_confidence_filter(spark, sf_dir):
    """Classes and confidence from two tables."""
    c, h, w = _class_grid(spark, sf_dir)
    size = Raster(w, h, g.RES)
    both = focal.with_confidence(c.drop("conf"), c.select("row", "col", "conf"), "conf", size, size)
    return focal.confidence_filter(both, "cls", "conf", h, w, 0.6, 5).select("row", "col", "cls")


# --- several rasters in one table ------------------------------------------------------------------------------
# Two layers of the same cells: an operator that mixed them would count each cell twice.


def _two_layers(df: DataFrame) -> DataFrame:
    return df.withColumn("layer", F.explode(F.array(F.lit("a"), F.lit("b"))))


def _layered(base: str, f) -> None:
    def run(spark, sf_dir):
        return f(spark, sf_dir)

    query(f"SELECT layer, t.* FROM ({ORACLE_SQL[base]}) t, (VALUES ('a'), ('b')) l(layer)", name=f"layers_{base}")(run)


def _of_dem(base: str, f) -> None:
    _layered(base, lambda spark, sf_dir: rounded(f(_two_layers(g.dem(spark, sf_dir)), g.height(spark, sf_dir, "orders", g.DEM_WIDTH))))


def _of_classes(base: str, f) -> None:
    _layered(base, lambda spark, sf_dir: f(_two_layers(g.classes(spark, sf_dir)), g.height(spark, sf_dir, "events", g.CLASS_WIDTH)))


_layered("dos1_corrected", lambda spark, sf_dir: rounded(preprocess.dos1(_two_layers(g.bands(spark, sf_dir).select("row", "col", "blue", "red")), ["blue", "red"], "uint8").select("layer", "row", "col", "blue", "red")))
_of_dem("box_sum", lambda p, h: preprocess.box_sums(p, {"total": F.col("dem")}, 3).select("layer", "row", "col", "total"))
_of_dem("integral_image", lambda p, h: preprocess.integral_image(p.na.fill(0.0, ["dem"]), "dem").select("layer", "row", "col", "integral"))
_of_dem("band_means", lambda p, h: preprocess.band_means(p, ["dem"], g.DEM_WIDTH, 16))
_of_dem("slope", lambda p, h: focal.terrain(p, "dem", g.RES).select("layer", "row", "col", "slope"))
_of_dem("aspect", lambda p, h: focal.terrain(p, "dem", g.RES).select("layer", "row", "col", "aspect"))
_of_classes("median_smooth", lambda p, h: focal.median_smooth(p, "cls", h, g.CLASS_WIDTH, 3).select("layer", "row", "col", "cls"))
_of_classes("confidence_filter", lambda p, h: focal.confidence_filter(p, "cls", "conf", h, g.CLASS_WIDTH, 0.6, 5).select("layer", "row", "col", "cls"))
_of_classes("majority_filter", lambda p, h: focal.majority_filter(p, "cls", h, g.CLASS_WIDTH, 3).select("layer", "row", "col", "cls"))
_of_classes("morphological_close", lambda p, h: focal.morphological_close(p, "cls", h, g.CLASS_WIDTH, 3).select("layer", "row", "col", "cls"))
_of_classes("components_4", lambda p, h: components.label_components(p, "cls", g.CLASS_WIDTH, 4, 32))
_of_classes("sieve", lambda p, h: components.sieve(p.drop("conf"), "cls", g.CLASS_WIDTH, 6, 4, 32).select("layer", "row", "col", "cls"))


# --- report sections over tables -------------------------------------------------------------------------------


@query(f"SELECT *, round(100.0 - pct_above, 6) AS low_conf_pct, 100.0 - pct_above > 15 AS note FROM ({ORACLE_SQL['confidence_stats']})")
def confidence_section(spark, sf_dir):
    return rounded(report.confidence_section(stats.confidence_stats(g.classes(spark, sf_dir), "conf")))


@query("SELECT CAST(doc_id AS VARCHAR) || '.txt' AS filename, round(octet_length(encode(text)) / 1024.0, 1) AS kb, sha256(text) AS sha256 FROM documents")
def manifest_section(spark, sf_dir):
    return report.manifest_section(checksums(spark, sf_dir).withColumn("filename", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


@query(f"SELECT class_id, CASE WHEN is_new THEN '∞ (new class)' ELSE printf('%+.1f%%', pct_change) END AS change, flagged FROM ({ORACLE_SQL['drift']})")
def drift_table(spark, sf_dir):
    return drift(spark, sf_dir).select("class_id", stats.drift_text(F.col("pct_change"), F.col("is_new")).alias("change"), "flagged")
