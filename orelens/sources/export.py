"""Exports: STAC items, checksummed packages, manifests."""

from __future__ import annotations

import hashlib
import json
import zipfile
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orelens.functions.geodesy import to_degrees

STAC_VERSION, PROJECTION = "1.0.0", "https://stac-extensions.github.io/projection/v1.0.0/schema.json"


@dataclass(frozen=True)
class ExportManifest:
    run_id: str
    exported_at: str
    zip_path: Path
    cog_path: Path
    stac_item_path: Path
    audit_log_path: Path
    file_checksums: dict[str, str] = field(default_factory=dict)
    file_sizes: dict[str, int] = field(default_factory=dict)


def bbox(bounds: Column, epsg: int | None) -> dict[str, Column]:
    """west, south, east, north in degrees, from the south-west and north-east corners."""
    code = epsg or 4326
    west, south = to_degrees(bounds["left"], bounds["bottom"], code)
    east, north = to_degrees(bounds["right"], bounds["top"], code)
    return {"west": west, "south": south, "east": east, "north": north}


def stac_items(rasters: DataFrame, run_id: str, epsg: int | None, properties: dict[str, Any] | None = None, now: datetime | None = None) -> DataFrame:
    """(id, item): a STAC item as JSON for each raster (filename, width, height, dtype, nodata, bounds), all of one system.

    Reserved properties win over those given; the acquisition time, if any, is kept as `acquired`.
    """
    stamp = (now or datetime.now(UTC)).isoformat()
    given = dict(properties or {})
    if "datetime" in given:
        given["acquired"] = given["datetime"]
    reserved = {"datetime", "created", "run_id", "proj:epsg", "proj:shape", "nodata", "dtype"}
    box = bbox(F.col("bounds"), epsg)
    w, s, e, n = (box[c] for c in ("west", "south", "east", "north"))
    point = lambda x, y: F.array(x, y)
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    extra = [F.from_json(F.lit(json.dumps(v)), "string").alias(k) if isinstance(v, (dict, list)) else F.lit(v).alias(k) for k, v in given.items() if k not in reserved]
    props = F.struct(
        *extra,
        F.lit(stamp).alias("datetime"),
        F.lit(stamp).alias("created"),
        F.lit(run_id).alias("run_id"),
        F.lit(epsg).cast("int").alias("proj:epsg"),
        F.array("height", "width").alias("proj:shape"),
        F.col("nodata").alias("nodata"),
        F.col("dtype").alias("dtype"),
    )
    item = F.struct(
        F.lit("Feature").alias("type"),
        F.lit(STAC_VERSION).alias("stac_version"),
        F.array(F.lit(PROJECTION)).alias("stac_extensions"),
        F.concat(F.lit(run_id + "_"), stem).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))).alias("coordinates")).alias("geometry"),
        F.array(w, s, e, n).alias("bbox"),
        props.alias("properties"),
        F.array().cast("array<string>").alias("links"),
        F.struct(F.struct(F.col("filename").alias("href"), F.lit("image/tiff; application=geotiff; profile=cloud-optimized").alias("type"), F.array(F.lit("data")).alias("roles"), stem.alias("title")).alias("data")).alias("assets"),
    )
    return rasters.select(item["id"].alias("id"), F.to_json(item).alias("item"))


def write_stac_item(item: str | dict, path: str | Path) -> Path:
    out = Path(path)
    out.write_text(json.dumps(json.loads(item) if isinstance(item, str) else item, indent=2, default=str), encoding="utf-8")
    return out


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(filename, bytes, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def find_artifact(paths: list[Path], suffix: str, hint: str) -> Path:
    """A file of that suffix whose name has the hint, else the first of the suffix, else nowhere."""
    same = [p for p in paths if p.suffix == suffix]
    return next((p for p in same if hint in p.stem.lower()), same[0] if same else Path("."))


def package_run(run_id: str, artifacts: list[str | Path], folder: str | Path) -> ExportManifest:
    """One ZIP of the artifacts with checksums and sizes by base name; nothing is written if one is missing."""
    paths = [Path(p) for p in artifacts]
    missing = [p for p in paths if not p.exists()]
    if missing:
        raise ValueError(f"artifact not found: {missing[0]}")
    sums, sizes = {}, {}
    for p in paths:
        digest = hashlib.sha256()
        with p.open("rb") as f:
            while chunk := f.read(1 << 20):
                digest.update(chunk)
        sums[p.name], sizes[p.name] = digest.hexdigest(), p.stat().st_size
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    archive = target / f"{run_id}_export.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in paths:
            z.write(p, p.name)
    return ExportManifest(run_id, datetime.now(UTC).isoformat(), archive, find_artifact(paths, ".tif", "cog"), find_artifact(paths, ".json", "stac"), find_artifact(paths, ".json", "audit"), sums, sizes)
