"""Validation gates over a table of layers, as rows (check, status, message, is_critical).

layers: name, layer_type, crs (text or NULL), res, date (NULL allowed), left, bottom, right, top, bands.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelens.functions.indices import overlap_pct

SCHEMA = "check string, status string, message string, is_critical boolean"
_SIDES = ("left", "bottom", "right", "top")
#: Pairs of layers that one task compares, and the layers (narrow rows) that are broadcast to be compared with.
TASK_PAIRS, BROADCAST_LAYERS = 1 << 24, 1_000_000


def _rows(df: DataFrame, check: Column, verdicts: list[tuple[Column | None, str, Column, bool]]) -> DataFrame:
    """The first condition that holds decides (status, message, critical); None is the otherwise."""
    out = None
    for when, status, message, critical in verdicts:
        value = F.struct(F.lit(status).alias("status"), message.alias("message"), F.lit(critical).alias("is_critical"))
        if when is None:
            out = value if out is None else out.otherwise(value)
        else:
            out = F.when(when, value) if out is None else out.when(when, value)
    return df.select(check.alias("check"), out.alias("v")).where(F.col("v").isNotNull()).select("check", "v.*")


def crs_match(layers: DataFrame) -> DataFrame:
    one = layers.agg(F.count("*").alias("n"), F.countDistinct("crs").alias("kinds"), F.sort_array(F.collect_list(F.when(F.col("crs").isNull(), F.col("name")))).alias("missing"), F.min("crs").alias("crs"))
    return _rows(
        one,
        F.lit("crs_match"),
        [
            (F.col("n") < 2, "ok", F.lit("Single layer: nothing to compare."), False),
            (F.size("missing") > 0, "error", F.concat(F.lit("Missing CRS on layer(s): "), F.array_join("missing", ", ")), True),
            (F.col("kinds") > 1, "error", F.format_string("CRS mismatch: %d reference systems. Reproject all layers to one.", "kinds"), True),
            (None, "ok", F.concat(F.lit("All layers share "), F.col("crs")), False),
        ],
    )


def resolution_compatibility(layers: DataFrame, max_ratio: float = 2.0) -> DataFrame:
    one = layers.agg(F.count("*").alias("n"), F.max(F.abs("res")).alias("hi"), F.min(F.abs("res")).alias("lo"))
    ratio = F.try_divide("hi", "lo")
    return _rows(
        one,
        F.lit("resolution_compatibility"),
        [
            (F.col("n") < 2, "ok", F.lit("Single layer: nothing to compare."), False),
            (ratio.isNull() | (ratio > max_ratio), "warn", F.format_string(f"Resolution ratio %.1f exceeds {max_ratio}.", ratio), False),
            (None, "ok", F.format_string(f"Resolution ratio %.1f is within {max_ratio}.", ratio), False),
        ],
    )


def date_proximity(layers: DataFrame, max_gap_days: int = 30) -> DataFrame:
    """The largest gap between any two dates is that between the first and the last."""
    one = layers.agg(F.count("date").alias("n"), F.date_diff(F.max("date"), F.min("date")).alias("gap"))
    return _rows(
        one,
        F.lit("date_proximity"),
        [
            (F.col("n") < 2, "warn", F.lit("Too few acquisition dates: check temporal alignment by hand."), False),
            (F.col("gap") > max_gap_days, "warn", F.format_string(f"Acquisition dates are up to %d days apart (threshold {max_gap_days}).", "gap"), False),
            (None, "ok", F.format_string("All layers acquired within %d days.", "gap"), False),
        ],
    )


def phenology_risk(layers: DataFrame, month_gap: int = 2) -> DataFrame:
    """One row if calendar months, years aside, span more than the gap; else none."""
    one = layers.agg(F.count("date").alias("n"), (F.max(F.month("date")) - F.min(F.month("date"))).alias("span"))
    return _rows(one, F.lit("phenology_risk"), [((F.col("n") >= 2) & (F.col("span") > month_gap), "warn", F.format_string("Layers span %d calendar months: vegetation features may be biased.", "span"), False)])


def _box(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}.{c}") for c in _SIDES}


def overlap_pairs(layers: DataFrame) -> DataFrame:
    """(a, b, overlap_pct) of every pair of layers: a theta join of a table with a row a layer.

    All pairs are results, so work is quadratic, while a file of that size is read by one task: rows are dealt out so
    that a task compares about TASK_PAIRS pairs.
    """
    n, boxes = layers.count(), layers.select("name", *_SIDES)
    tasks = min(n, -(-n * n // TASK_PAIRS))
    dealt = boxes.repartition(tasks) if tasks > 1 else boxes
    others = F.broadcast(boxes) if n <= BROADCAST_LAYERS else boxes
    return dealt.alias("a").join(others.alias("b"), F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), overlap_pct(_box("a"), _box("b")).alias("overlap_pct"))


def minimum_overlap(layers: DataFrame, min_pct: float = 80.0) -> DataFrame:
    one = overlap_pairs(layers).agg(F.count("*").alias("n"), F.min("overlap_pct").alias("least"), F.count_if(F.col("overlap_pct") < min_pct).alias("low"))
    return _rows(
        one,
        F.lit("minimum_overlap"),
        [
            (F.col("n") == 0, "ok", F.lit("Single layer: no overlap to check."), False),
            (F.col("low") > 0, "error", F.format_string(f"%d pair(s) overlap less than {min_pct}%%; the least is %.1f%%.", "low", "least"), True),
            (None, "ok", F.format_string(f"All pairs overlap by %.1f%% or more (threshold {min_pct}%%).", "least"), False),
        ],
    )


def band_counts(layers: DataFrame) -> DataFrame:
    kind, n = F.col("layer_type"), F.col("bands")
    say = lambda text: F.concat(F.col("name"), F.format_string(text, n))
    return _rows(
        layers,
        F.concat(F.lit("band_count_"), F.col("name")),
        [
            ((kind == "sar") & ~n.isin(1, 2, 4), "warn", say(": %d radar bands; 1, 2 or 4 are expected."), False),
            ((kind == "dem") & (n != 1), "warn", say(": %d bands in an elevation model; 1 is expected."), False),
            ((kind == "optical") & (n < 3), "error", say(": only %d optical band(s); 3 are the minimum."), False),
            (None, "ok", say(": %d band(s), valid."), False),
        ],
    )


def label_alignment(pairs: DataFrame, tolerance_px: float = 0.5) -> DataFrame:
    """Rows with struct columns `label` and `feature` (crs, res, x, y): system, then pixel size, then origin."""
    lab, feat = (lambda c: F.col(f"label.{c}")), (lambda c: F.col(f"feature.{c}"))
    res = F.abs(feat("res"))
    off = F.hypot(lab("x") - feat("x"), lab("y") - feat("y"))
    return _rows(
        pairs,
        F.lit("label_alignment"),
        [
            (lab("crs").isNull() | feat("crs").isNull(), "error", F.lit("CRS is missing on the label or the feature stack."), True),
            (lab("crs") != feat("crs"), "error", F.concat(F.lit("CRS mismatch: "), lab("crs"), F.lit(" and "), feat("crs")), True),
            (F.abs(F.abs(lab("res")) - res) > tolerance_px * res, "error", F.format_string("Resolution mismatch: %.4f and %.4f.", F.abs(lab("res")), res), True),
            (off > tolerance_px * res, "error", F.format_string("Origins are %.4f units apart.", off), True),
            (None, "ok", F.format_string("Labels are aligned (offset %.4f units).", off), False),
        ],
    )


def shapefile_alignment(pairs: DataFrame) -> DataFrame:
    """Rows with struct columns `shape` (crs, bounds, class_labels) and `feature` (crs, bounds): systems may differ."""
    box = lambda side: {c: F.col(f"{side}.{c}") for c in ("left", "bottom", "right", "top")}
    over, n = overlap_pct(box("shape"), box("feature")), F.size("shape.class_labels")
    return _rows(
        pairs,
        F.lit("shapefile_alignment"),
        [
            (F.col("shape.crs").isNull(), "error", F.lit("The polygons have no CRS."), True),
            (F.col("feature.crs").isNull(), "error", F.lit("The feature stack has no CRS."), True),
            (F.col("shape.left").isNull() | F.col("feature.left").isNull(), "error", F.lit("Bounds are missing."), True),
            (over < 50.0, "error", F.format_string("Polygons cover only %.1f%% of the features (50%% are needed).", over), True),
            (n < 2, "error", F.format_string("%d class(es); two are needed.", n), True),
            (None, "ok", F.format_string("Polygons fit (%.1f%% overlap, %d classes).", over, n), False),
        ],
    )


def drone_inputs(rasters: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """Five rows for each raster (name, bands, dtype, width, height, res, projected, file_bytes)."""
    limit, block = float(cfg.get("drone_pixel_res_threshold_m", 1.0)), int(cfg.get("drone_block_size", 256))
    res = F.abs("res") * F.when(F.col("projected"), 1.0).otherwise(111_320.0)
    fine, bytes_ = res < limit, F.col("dtype") == "uint8"
    gb = F.col("file_bytes") / float(1 << 30)
    tiles = F.ceil(F.col("height") / block) * F.ceil(F.col("width") / block)
    area = F.col("width") * F.col("height") * res * res / 10000.0
    scaled = bool(cfg.get("drone_rgb_scale_to_float", False))
    parts = [
        ("drone_band_count", [(F.col("bands") < 3, "error", F.format_string("Only %d band(s); red, green and blue are needed.", "bands"), True), (None, "ok", F.format_string("%d bands.", "bands"), False)]),
        ("drone_resolution", [(res >= limit, "warn", F.format_string(f"%.2f m a pixel is not below {limit} m: satellite imagery?", res), False), (None, "ok", F.format_string("%.1f cm a pixel.", res * 100), False)]),
        ("drone_band_scaling", [(fine & bytes_ & F.lit(not scaled), "warn", F.lit("Bands are bytes and scaling to [0, 1] is off."), False), (fine & bytes_, "ok", F.lit("Bytes will be scaled to [0, 1]."), False), (None, "ok", F.concat(F.lit("No scaling for "), F.col("dtype")), False)]),
        ("drone_file_size", [(gb > 2.0, "warn", F.format_string("%.1f GB in %d tiles; about %.0f min.", gb, tiles, tiles * 0.05 / 60), False), (None, "ok", F.format_string("%.0f MB.", gb * 1024), False)]),
        ("drone_survey_area", [(res > 0, "ok", F.format_string("%.2f ha.", area), False)]),
    ]
    return reduce(DataFrame.unionByName, [_rows(rasters, F.lit(name), verdicts) for name, verdicts in parts])


def run_all(layers: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    get = cfg.get
    parts = [
        crs_match(layers),
        resolution_compatibility(layers, float(get("max_resolution_ratio", 2.0))),
        date_proximity(layers, int(get("max_date_gap_days", 30))),
        phenology_risk(layers, int(get("phenology_month_gap", 2))),
        minimum_overlap(layers, float(get("min_overlap_pct", 80.0))),
        band_counts(layers),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary(results: DataFrame) -> DataFrame:
    """One row: counts of ok, warn and error."""
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "error")])


def has_critical(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_or((F.col("status") == "error") & F.col("is_critical")), F.lit(False)).alias("blocked"))
