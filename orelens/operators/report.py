"""The data behind reports: each section as rows; rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import exact_quantiles


def shown(value: Column, kind: str = "string") -> Column:
    """A value as reports show it: N/A for NULL, four decimals for fractions, Yes and No for truth values."""
    text = {"double": lambda: F.format_string("%.4f", value), "boolean": lambda: F.when(value, "Yes").otherwise("No")}.get(kind, lambda: value.cast("string"))()
    return F.when(value.isNull(), "N/A").otherwise(text)


def pairs(row: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(label, value): a one-row table unpivoted as shown text."""
    kinds = dict(row.dtypes)
    kind = lambda c: "double" if kinds[c] in ("double", "float") else kinds[c]
    return row.select(F.explode(F.array(*[F.struct(F.lit(text).alias("label"), shown(F.col(c), kind(c)).alias("value")) for c, text in labels.items()])).alias("p")).select("p.*")


def executive_summary(metrics: DataFrame, areas: DataFrame) -> DataFrame:
    """metrics: one row (oa, kappa, minority_f1, gate_passed, and where they are known model_type, smote_applied and the
    independent points' point_oa and point_kappa); areas: class areas."""
    known = {c: text for c, text in {"model_type": "Model type", "smote_applied": "SMOTE applied", "point_oa": "Overall accuracy (points)", "point_kappa": "Cohen's kappa (points)"}.items() if c in metrics.columns}
    totals = areas.agg(F.count("*").alias("n_classes"), F.sum("pixel_count").alias("pixels"), F.sum("area_ha").alias("area_ha"), F.max_by("class_id", F.struct("area_pct", -F.col("class_id"))).alias("dominant"), F.max("area_pct").alias("dominant_pct"))
    return pairs(metrics.join(totals), {"oa": "Overall accuracy", "kappa": "Cohen's kappa", "minority_f1": "Minority F1", "gate_passed": "Quality gate passed", "n_classes": "Classes", "pixels": "Classified pixels", "area_ha": "Total area (ha)", "dominant": "Dominant class", "dominant_pct": "Dominant class (%)"} | known)


def area_section(areas: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(class_id, class_name, pixel_count, area_ha, area_pct) rounded to two and one decimals."""
    out = areas.join(names, "class_id", "left") if names is not None else areas.withColumn("class_name", F.lit(None).cast("string"))
    name = F.coalesce("class_name", F.concat(F.lit("Class "), F.col("class_id").cast("string")))
    return out.select("class_id", name.alias("class_name"), "pixel_count", F.round("area_ha", 2).alias("area_ha"), F.round("area_pct", 1).alias("area_pct"))


#: Map colours by class number.
COLOURS = {1: "#8B4513", 2: "#DAA520", 3: "#DC143C", 4: "#228B22", 5: "#4169E1", 6: "#A0522D"}
OTHER_COLOUR = "#AAAAAA"


def legend_section(areas: DataFrame, names: DataFrame) -> DataFrame:
    """(class_id, class_name, colour, area_ha, area_pct): every defined class, with zeros where the map has none of it."""
    shade = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in COLOURS.items() for v in pair]), F.col("class_id").cast("int")), F.lit(OTHER_COLOUR))
    part = lambda c, digits: F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c)
    return names.join(areas, "class_id", "left").select("class_id", "class_name", shade.alias("colour"), part("area_ha", 2), part("area_pct", 1))


def cover(run_id: str, date: str, site: str = "", operator: str = "", survey_type: str = "Satellite", mode: str = "pit_wall") -> list[tuple[str, str]]:
    """(label, value) of a survey report's first page."""
    return [("Site", site or "N/A"), ("Prepared by", operator or "N/A"), ("Date", date[:10]), ("Run", run_id), ("Survey type", survey_type), ("Kind", mode.replace("_", " ").title())]


def methodology(config, result, cfg: dict, features=(), fold_oa=()) -> list[tuple[str, str]]:
    """(label, value): how a survey's map was made; config and result as operators.ml has them, or None."""
    return [
        ("Model type", "N/A" if config is None else config.model_type),
        ("Folds", f"{cfg.get('default_k_folds', 5)}, stratified"),
        ("SMOTE applied", "N/A" if result is None else "Yes" if result.smote_applied else "No"),
        ("Accuracy of each fold", ", ".join(f"{x:.3f}" for x in fold_oa) or "N/A"),
        ("Minimum mapping unit (ha)", str(cfg.get("min_mapping_unit_ha", 0.5))),
        ("Largest coregistration RMSE (px)", str(cfg.get("coreg_rmse_threshold", 0.5))),
        ("Least overall accuracy", f"{cfg.get('min_oa_threshold', 0.8):.0%}"),
        ("Least minority F1", f"{cfg.get('min_minority_f1', 0.7):.0%}"),
        ("Features", ", ".join(features) or "N/A"),
    ]


#: Sections of the two kinds of report, in their order.
SESSION = ("executive_summary", "classification", "confidence", "postprocessing", "quality_gates", "class_areas", "configuration", "audit")
SURVEY = ("cover", "executive_summary", "map_legend", "confidence", "change", "methodology", "importances", "audit")


def assemble(parts: dict[str, DataFrame], order: tuple[str, ...] = SESSION) -> DataFrame:
    """(number, section, content): a report as one table, each row of a section as JSON; a section without rows or without a
    table (such as change, where no earlier survey exists) has one row of NULL content."""
    if not parts or set(parts) - set(order):
        raise ValueError(f"sections are some of {', '.join(order)}")
    heads = next(iter(parts.values())).sparkSession.createDataFrame(list(enumerate(order, 1)), "number int, section string")
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content"))
        rows = one if rows is None else rows.unionByName(one)
    return heads.join(rows, "section", "left").select("number", "section", "content")


def confidence_section(stats: DataFrame, note_above: float = 15.0) -> DataFrame:
    """The statistics with low_conf_pct (what isn't above the threshold) and whether that is worth a note."""
    low = 100.0 - F.col("pct_above")
    return stats.withColumns({"low_conf_pct": low, "note": F.coalesce(low > note_above, F.lit(False))})


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def audit_section(events: DataFrame, n: int = 50, latest: bool = True) -> DataFrame:
    """The last n events, newest first; or the first n."""
    order = [F.col("timestamp").desc(), F.col("event_type")] if latest else [F.col("timestamp"), F.col("event_type")]
    stage = F.coalesce(F.get_json_object("details", "$.stage"), F.lit("—"))
    return events.orderBy(*order).limit(n).select("timestamp", "event_type", stage.alias("stage"), F.coalesce("decision", F.lit("—")).alias("decision"))


def manifest_section(files: DataFrame) -> DataFrame:
    return files.select("filename", F.round(F.col("bytes") / 1024.0, 1).alias("kb"), "sha256")


def candidate_sources(raw: DataFrame, preprocessed: DataFrame) -> DataFrame:
    """(layer, path): a preprocessed file takes the raw one's place."""
    return raw.withColumnRenamed("path", "_raw").join(preprocessed.withColumnRenamed("path", "_new"), "layer", "left").select("layer", F.coalesce("_new", "_raw").alias("path"))


def stretch(pixels: DataFrame, band: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Percentile stretch to [0, 1] for previews."""
    lo, hi = exact_quantiles(pixels, band, [low, high])
    if lo is None or hi <= lo:
        return pixels.withColumn(band, F.when(F.col(band).isNotNull(), 0.0))
    return pixels.withColumn(band, F.when(F.col(band).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(band) - lo) / (hi - lo)))))


def chain_parameters(steps: list[str], cfg: dict) -> list[tuple[str, str]]:
    """(parameter, value): which steps ran, by the keys that the chain itself returns, and their settings."""
    yes = lambda *keys: "Yes" if any(s.startswith(k) for k in keys for s in steps) else "No"
    return [
        ("Confidence filter", yes("confidence_filter")),
        ("Smoothing", yes("median_smooth", "smooth_pass")),
        ("Morphological close", yes("morphological_close")),
        ("Sieve", yes("sieve_filter")),
        ("Confidence threshold", str(cfg.get("confidence_threshold", 0.6))),
        ("Median kernel", str(cfg.get("median_filter_size", 3))),
        ("Closing kernel", str(cfg.get("morphological_kernel_size", 3))),
        ("Minimum mapping unit (ha)", str(cfg.get("min_mapping_unit_ha", 0.5))),
    ]


def configuration(cfg: dict) -> list[tuple[str, str]]:
    """(label, value) of the settings that a run was made with."""
    keys = (
        ("Target reference system", "target_crs"),
        ("Pixel size (m)", "target_resolution_m"),
        ("Looks (radar default)", "sar_enl_default"),
        ("Looks (Sentinel-1 IW)", "sar_enl_sentinel1_iw"),
        ("Minimum overlap (%)", "min_overlap_pct"),
        ("Largest resolution ratio", "max_resolution_ratio"),
        ("Largest date gap (days)", "max_date_gap_days"),
        ("Least overall accuracy", "min_oa_threshold"),
        ("Least minority F1", "min_minority_f1"),
        ("Largest coregistration RMSE (px)", "coreg_rmse_threshold"),
    )
    return [(label, str(cfg.get(k, "N/A"))) for label, k in keys]


def model_section(result, config) -> list[tuple[str, str]]:
    """(label, value) of a model's parameters and global metrics; result and config as operators.ml has them."""
    number = lambda x: "N/A" if x is None else f"{x:.4f}"
    return [
        ("Model type", config.model_type),
        ("Trees", str(config.n_estimators)),
        ("Depth", "N/A" if config.max_depth is None else str(config.max_depth)),
        ("SMOTE applied", "Yes" if result.smote_applied else "No"),
        ("Random state", str(config.random_state)),
        ("Overall accuracy", number(result.oa)),
        ("Cohen's kappa", number(result.kappa)),
        ("Minority F1", number(result.minority_f1)),
        ("Quality gate", result.gate_message),
    ]


def fold_section(folds: DataFrame) -> DataFrame:
    """One row: mean, least and largest overall accuracy of the folds, as text with four decimals."""
    shown_ = lambda c: F.format_string("%.4f", c)
    return folds.agg(shown_(F.avg("oa")).alias("mean"), shown_(F.min("oa")).alias("min"), shown_(F.max("oa")).alias("max"))


def item_properties(result, features, gates: DataFrame, accuracy: dict | None = None) -> dict:
    """What an exported item says about its run: features, metrics to four decimals, gates and the worst of them."""
    out = {"features": list(features)}
    if result is not None:
        out |= {f"model_{k}": round(v, 4) for k, v in (("oa", result.oa), ("kappa", result.kappa), ("minority_f1", result.minority_f1)) if v is not None}
        out["classes"] = list(result.classes)
    for k, v in (accuracy or {}).items():
        out[f"accuracy_{k}"] = round(v, 4) if isinstance(v, float) else v
    rows = gates.orderBy("gate").collect()  # one row a gate
    out["gate_status"] = max((r.status for r in rows), key=("pass", "warning", "fail").index, default="pass")
    out["gate_results"] = [{"metric": r.metric, "value": round(r.value, 4), "status": r.status} for r in rows]
    return out
