"""Class areas of tiles as they arrive: the batch aggregate over a stream of pixel files.

Nothing the workflow computes on whole rasters needs event time; this serves surveys that are flown and classified
strip by strip. State is one row a layer and class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tiles(spark: SparkSession, path: str, schema: str = "layer string, row int, col int, cls int, conf double", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_areas(tiles: DataFrame, res_m: float) -> DataFrame:
    """(layer, class_id, pixel_count, area_ha, mean_conf), for complete or update output."""
    counts = tiles.where(F.col("cls").isNotNull()).groupBy("layer", F.col("cls").alias("class_id")).agg(F.count("*").alias("pixel_count"), F.avg("conf").alias("mean_conf"))
    return counts.withColumn("area_ha", F.col("pixel_count") * (res_m * res_m / 10000.0))
