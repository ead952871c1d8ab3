"""Accuracy of predicted against true classes, and assessment from reference points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orelens.functions.geodesy import to_projected
from orelens.model import Raster


def confusion(pairs: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n): the one shuffle that every metric below starts from; its size is that of the classes squared."""
    return pairs.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(conf: DataFrame, classes: list[int]) -> DataFrame:
    """Rows of true classes, a column for each predicted class."""
    return conf.groupBy("true").pivot("pred", classes).agg(F.sum("n")).na.fill(0)


def overall(conf: DataFrame) -> DataFrame:
    """One row: oa and Cohen's kappa (NULL if chance agreement is certain)."""
    rows = conf.groupBy(F.col("true").alias("k")).agg(F.sum("n").alias("r"))
    cols = conf.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("rc"))
    agree = conf.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))), F.lit(0)).alias("hit"))
    po, pe = F.col("hit") / F.col("n"), F.col("rc") / (F.col("n").cast("double") * F.col("n"))
    return agree.join(chance).select(po.alias("oa"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def per_class(conf: DataFrame) -> DataFrame:
    """(class_id, precision, recall, f1, support) of each class that is true or predicted somewhere; 0 for 0/0."""
    sides = conf.select(F.explode(F.array(F.struct(F.col("true").alias("class_id"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("s")).select("s.*")
    sums = sides.groupBy("class_id").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("class_id", ratio(F.col("h"), F.col("p")).alias("precision"), ratio(F.col("h"), F.col("t")).alias("recall"), ratio(2.0 * F.col("h"), F.col("p") + F.col("t")).alias("f1"), F.col("t").alias("support"))


def minority_f1(metrics: DataFrame) -> DataFrame:
    """One row: the smallest F1 outside the class with the most support (the smallest such class); 1 for one class."""
    rank = F.row_number().over(Window.orderBy(F.col("support").desc(), "class_id"))  # one row a class
    return metrics.withColumn("rank", rank).agg(F.coalesce(F.min(F.when(F.col("rank") > 1, F.col("f1"))), F.lit(1.0)).alias("minority_f1"))


def point_cells(points: DataFrame, raster: Raster) -> DataFrame:
    """Reference points (lat, lon, class as text) with their cell and, where one applies, why they are discarded."""
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)")
    parsed = points.withColumns({"_lat": number("lat"), "_lon": number("lon"), "_class": F.expr("try_cast(trim(`class`) AS INT)")})
    x, y = to_projected(F.col("_lon"), F.col("_lat"), raster.epsg or 4326)
    placed = parsed.withColumns({"_x": x, "_y": y})
    sound = F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") < 1e12) & ~F.isnan("_y")
    row = F.when(sound, F.floor((raster.y_origin - F.col("_y")) / raster.res)).cast("int")
    col = F.when(sound, F.floor((F.col("_x") - raster.x_origin) / raster.res)).cast("int")
    placed = placed.withColumns({"row": row, "col": col})
    inside = F.col("row").between(0, raster.height - 1) & F.col("col").between(0, raster.width - 1)
    missing = F.col("_lat").isNull() | F.col("_lon").isNull() | F.col("_class").isNull()
    reason = F.when(missing, "missing_fields").when(F.col("row").isNull(), "reproject_error").when(~inside, "out_of_bounds")
    return placed.select(F.col("_class").alias("true"), "row", "col", reason.alias("reason"))


def assess_points(points: DataFrame, classes: DataFrame, cls: str, raster: Raster) -> tuple[DataFrame, DataFrame]:
    """(pairs (true, pred), discards (reason, n)). Fewer than two usable points are an error."""
    cells = point_cells(points, raster).join(classes.select("row", "col", F.col(cls).cast("int").alias("pred")), ["row", "col"], "left")
    cells = cells.withColumn("reason", F.coalesce("reason", F.when(F.col("pred").isNull(), "nodata_pixel")))
    pairs = cells.where(F.col("reason").isNull()).select("true", "pred")
    if pairs.limit(2).count() < 2:
        raise ValueError("fewer than two reference points fall on valid pixels")
    return pairs, cells.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
