"""Layers from file names, tags and band counts: sensor, type, acquisition date, metadata table, input discovery."""

from __future__ import annotations

import zipfile
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name patterns in order, and the sensors they stand for.
SENSOR_PATTERNS = (
    ("S1[AB]_", "Sentinel-1"),
    ("S2[AB]_", "Sentinel-2"),
    ("LC0[89]_", "Landsat 8/9"),
    ("LC07_", "Landsat 7"),
    ("dem|dtm|dsm", "DEM"),
)
#: Tags that hold an acquisition date, in order, and the formats tried, in Spark's notation.
DATE_TAGS = ("ACQUISITION_DATE", "DATE_ACQUIRED", "SENSING_TIME", "START_TIME", "PRODUCT_START_TIME", "TIFFTAG_DATETIME")
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd")
FILE_DATES = (r"(\d{4})(\d{2})(\d{2})", r"(\d{4})-(\d{2})-(\d{2})")
TIFFS = (".tif", ".tiff")


def sensor(filename: Column, bands: Column, tags: Column) -> Column:
    """File name first, then words in any tag, then the number of bands."""
    out = F
    for pattern, name in SENSOR_PATTERNS:
        out = out.when(filename.rlike("(?i)" + pattern), name)
    said = F.lower(F.array_join(F.map_values(tags), " "))
    out = out.when(said.rlike("elevation|height|dtm|dsm|dem"), "DEM").when(said.contains("sentinel"), "Sentinel (unknown)").when(said.contains("landsat"), "Landsat (unknown)")
    return out.when(bands == 1, "Single-band (SAR or DEM)").when(bands.isin(3, 4), "Multispectral RGB/RGBN").when(bands >= 5, "Multispectral / Hyperspectral").otherwise("Unknown")


def layer_type(sensor: Column, bands: Column) -> Column:
    s = F.lower(sensor)
    return (
        F.when(s.rlike("sentinel-1|sar"), "sar")
        .when(s.rlike("dem|dtm|dsm|elevation"), "dem")
        .when(s.rlike("sentinel-2|landsat|multispectral|hyperspectral"), "optical")
        .when(bands == 1, "sar")
        .otherwise("unknown")
    )


def _file_date(filename: Column, pattern: str) -> Column:
    """Only a pattern's first match counts."""
    year, month, day = (F.regexp_extract(filename, pattern, i) for i in (1, 2, 3))
    return F.to_date(F.try_to_timestamp(F.when(year != "", F.concat_ws("-", year, month, day)), F.lit("yyyy-MM-dd")))


def acquisition_date(filename: Column, tags: Column) -> Column:
    """Tags before the file name; what isn't a date is passed over."""
    known = [F.to_date(F.try_to_timestamp(F.trim(F.get(F.filter(F.array(tags[t]), lambda v: F.trim(v) != ""), 0)), F.lit(f))) for t in DATE_TAGS for f in DATE_FORMATS]
    return F.coalesce(*known, *[_file_date(filename, p) for p in FILE_DATES])


def describe(files: DataFrame) -> DataFrame:
    """files (filename, bands, tags) with sensor, layer_type and date."""
    s = files.withColumn("sensor", sensor(F.col("filename"), F.col("bands"), F.col("tags")))
    return s.withColumns({"layer_type": layer_type(F.col("sensor"), F.col("bands")), "date": acquisition_date(F.col("filename"), F.col("tags"))})


def metadata_table(layers: DataFrame) -> DataFrame:
    """Eleven display columns of layers (layer, filename, sensor, layer_type, date, crs_epsg, crs, bands, width, height,
    res, nodata)."""
    crs = F.coalesce(F.concat(F.lit("EPSG:"), F.col("crs_epsg").cast("string")), F.col("crs"), F.lit("No CRS"))
    return layers.select(
        F.col("layer").alias("layer_key"),
        "filename",
        "sensor",
        F.col("layer_type").alias("type"),
        F.coalesce(F.col("date").cast("string"), F.lit("Unknown")).alias("date"),
        crs.alias("crs"),
        "bands",
        F.col("width").alias("width_px"),
        F.col("height").alias("height_px"),
        F.format_string("%.4f", F.abs("res")).alias("gsd"),
        F.coalesce(F.col("nodata").cast("string"), F.lit("None")).alias("nodata"),
    )


def discover(spark: SparkSession, folder: str) -> str | None:
    """The raster to start from: one whose name says stack, else the largest; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    found = files.orderBy(F.lower("path").contains("stack").desc(), F.col("length").desc(), "path").limit(1).collect()
    return found[0].path if found else None


def unzip_first_tif(archive: str | Path, folder: str | Path) -> Path:
    """The archive's first TIFF, under its base name alone; ValueError if there is none."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if PurePosixPath(name).suffix.lower() in TIFFS:
                out = Path(folder) / PurePosixPath(name).name
                out.parent.mkdir(parents=True, exist_ok=True)
                with z.open(name) as src, out.open("wb") as dst:
                    while chunk := src.read(128 * 1024):
                        dst.write(chunk)
                return out
    raise ValueError(f"no TIFF in {archive}")


def unzip_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """(archive, name, content) of every TIFF in many archives, spread over the cluster."""
    import io

    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if PurePosixPath(n).suffix.lower() in TIFFS]
                    for n in names:
                        yield pd.DataFrame({"archive": [path], "name": [PurePosixPath(n).name], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def ingest(spark: SparkSession, path: str | Path, extract_to: str | Path | None = None) -> DataFrame:
    """One layer row of a TIFF or of a ZIP's first TIFF, from its header alone."""
    from .geotiff import header_row

    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(p)
    if p.suffix.lower() == ".zip":
        p = unzip_first_tif(p, extract_to or p.parent)
    elif p.suffix.lower() not in TIFFS:
        raise ValueError(f"{p.suffix or 'no'} is not a supported file type: give a TIFF or a ZIP")
    return describe(header_row(spark, p))


def reference_points(spark: SparkSession, path: str) -> DataFrame:
    """CSV of lat, lon, class; all text, as rows that can't be read are counted later, not dropped."""
    return spark.read.csv(path, header=True)
