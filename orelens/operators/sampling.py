"""Training samples: pixels that labels or polygons cover, drawn with exact sizes and reproducibly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orelens.functions.geodesy import contains
from orelens.model import Raster

from .grid import layer_of


def draw_order(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def stratified_subsample(samples: DataFrame, label: str, most: int, seed: int = 42, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """At most about `most` rows, classes in proportion: each keeps min(n, max(1, round half even of its share)), by
    the order of a hash. Tables that are small enough stay whole."""
    counts = samples.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    share = F.bround(most * F.col("_n") / F.col("_total"))
    sizes = sizes.withColumn("_take", F.when(F.col("_total") <= most, F.col("_n")).otherwise(F.least("_n", F.greatest(F.lit(1), share)))).select(label, "_take")
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw_order(seed, *keys), *keys))
    return samples.withColumn("_rank", rank).join(F.broadcast(sizes), label).where(F.col("_rank") <= F.col("_take")).drop("_rank", "_take")


def extract_from_labels(features: DataFrame, labels: DataFrame, names: list[str], label: str = "label", unlabeled: int = 0, most: int | None = None, seed: int = 42) -> DataFrame:
    """(row, col, features, label) of pixels that are labelled and whose features are all valid."""
    layer = layer_of(features) if layer_of(labels) else ()
    joined = features.join(labels.where(F.col(label).isNotNull() & (F.col(label) != unlabeled)).select(*layer, "row", "col", F.col(label).cast("int")), [*layer, "row", "col"])
    valid = joined.na.drop(how="any", subset=names).select(*layer, "row", "col", *names, label)
    if not valid.limit(1).count():
        raise ValueError("no labelled pixel has valid features")
    return stratified_subsample(valid, label, most, seed) if most else valid


def polygon_pixels(features: DataFrame, polygons: DataFrame, raster: Raster) -> DataFrame:
    """Pixels whose centre lies in a polygon (poly_id, class_id, rings): each polygon for itself, so overlaps repeat pixels.

    A polygon's box gives the tiles it may touch; tiles are the join key, and the exact test follows.
    """
    block = 64
    x = F.transform(F.flatten("rings"), lambda p: p["x"])
    y = F.transform(F.flatten("rings"), lambda p: p["y"])
    tile = lambda v, n: F.greatest(F.lit(0), F.least(F.lit((n - 1) // block), F.floor(v / block))).cast("int")
    boxed = polygons.withColumns(
        {
            "_c0": tile((F.array_min(x) - raster.x_origin) / raster.res, raster.width),
            "_c1": tile((F.array_max(x) - raster.x_origin) / raster.res, raster.width),
            "_r0": tile((raster.y_origin - F.array_max(y)) / raster.res, raster.height),
            "_r1": tile((raster.y_origin - F.array_min(y)) / raster.res, raster.height),
        }
    )
    tiled = boxed.withColumn("_tr", F.explode(F.sequence("_r0", "_r1"))).withColumn("_tc", F.explode(F.sequence("_c0", "_c1"))).drop("_r0", "_r1", "_c0", "_c1")
    placed = features.withColumns({"_tr": F.floor(F.col("row") / block).cast("int"), "_tc": F.floor(F.col("col") / block).cast("int")})
    cx, cy = raster.x_origin + (F.col("col") + 0.5) * raster.res, raster.y_origin - (F.col("row") + 0.5) * raster.res
    return placed.join(tiled, ["_tr", "_tc"]).where(contains(F.col("rings"), cx, cy)).drop("_tr", "_tc", "rings")


def cap_per_polygon(pixels: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most so many pixels of each polygon; 0 leaves all."""
    if not most:
        return pixels
    rank = F.row_number().over(Window.partitionBy("poly_id").orderBy(draw_order(seed, "row", "col"), "row", "col"))
    return pixels.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def extract_from_polygons(features: DataFrame, polygons: DataFrame, names: list[str], raster: Raster, per_polygon: int = 0, seed: int = 42) -> DataFrame:
    """(poly_id, row, col, features, label) of valid pixels in polygons."""
    found = polygon_pixels(features.na.drop(how="any", subset=names), polygons, raster)
    out = cap_per_polygon(found, per_polygon, seed).select("poly_id", "row", "col", *names, F.col("class_id").cast("int").alias("label"))
    if not out.limit(1).count():
        raise ValueError("no polygon covers a pixel with valid features")
    return out


def polygon_meta(polygons: DataFrame) -> DataFrame:
    """One row: bounds of all rings and the sorted distinct classes."""
    point = F.explode(F.flatten("rings"))
    box = polygons.select(point.alias("p")).agg(F.min("p.x").alias("left"), F.min("p.y").alias("bottom"), F.max("p.x").alias("right"), F.max("p.y").alias("top"))
    return box.join(polygons.agg(F.sort_array(F.collect_set(F.col("class_id").cast("int"))).alias("class_labels")))
