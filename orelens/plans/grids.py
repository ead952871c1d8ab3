"""The driver's tables seen as rasters, for the named queries: the same mapping as DataFrames and as SQL.

events: 100 pixels a row, the event type as class, value / 100 as confidence. orders: 100 a row, the total price as an
elevation or radar band. embeddings: 25 a row, the first nine components, shifted by 0.5, as bands. Every 97th cell
is nodata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelens.model import BandMap

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BANDS = ("blue", "green", "red", "nir", "swir", "rededge", "vv", "vh", "dem")
BAND_MAP = BandMap.of(BANDS)
CLASS_WIDTH, DEM_WIDTH, BAND_WIDTH, RES = 100, 100, 25, 10.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _cell(key: str, width: int):
    k = F.col(key)
    return [F.floor(k / width).cast("int").alias("row"), (k % width).cast("int").alias("col"), (k % 97 != 0).alias("ok")]


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, cls, conf)"""
    number = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")).cast("int")
    cells = read(spark, sf_dir, "events").select(*_cell("event_id", CLASS_WIDTH), number.alias("cls"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("conf"))
    return cells.select("row", "col", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("cls", "conf")])


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, dem)"""
    cells = read(spark, sf_dir, "orders").select(*_cell("o_orderkey", DEM_WIDTH), "o_totalprice")
    return cells.select("row", "col", F.when(F.col("ok"), F.col("o_totalprice") / 1000.0).alias("dem"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, nine bands, label)"""
    cells = read(spark, sf_dir, "embeddings").select(*_cell("vec_id", BAND_WIDTH), "embedding", "label")
    return cells.select("row", "col", *[F.when(F.col("ok"), F.get("embedding", i).cast("double") + 0.5).alias(b) for i, b in enumerate(BANDS)], "label")


def height(spark: SparkSession, sf_dir: str, table: str, width: int) -> int:
    """Rows of the grid; a count from file footers."""
    return -(-read(spark, sf_dir, table).count() // width)


CLASSES_SQL = f"""c AS (
  SELECT CAST(event_id // {CLASS_WIDTH} AS INTEGER) AS row, CAST(event_id % {CLASS_WIDTH} AS INTEGER) AS col,
         CASE WHEN event_id % 97 <> 0 THEN CAST(list_position({list(EVENT_TYPES)}, event_type) AS INTEGER) END AS cls,
         CASE WHEN event_id % 97 <> 0 THEN least(value / 100.0, 1.0) END AS conf FROM events)"""
DEM_SQL = f"""d AS (
  SELECT CAST(o_orderkey // {DEM_WIDTH} AS INTEGER) AS row, CAST(o_orderkey % {DEM_WIDTH} AS INTEGER) AS col,
         CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice / 1000.0 END AS dem FROM orders)"""
BANDS_SQL = f"""b AS (
  SELECT CAST(vec_id // {BAND_WIDTH} AS INTEGER) AS row, CAST(vec_id % {BAND_WIDTH} AS INTEGER) AS col, label,
         {", ".join(f"CASE WHEN vec_id % 97 <> 0 THEN CAST(embedding[{i + 1}] AS DOUBLE) + 0.5 END AS {n}" for i, n in enumerate(BANDS))}
  FROM embeddings)"""
