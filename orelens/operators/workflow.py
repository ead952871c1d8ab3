"""Composite operators: the feature stack with its statistics, the post-processing chain, the whole survey run."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelens.functions.indices import INDICES
from orelens.model import BandMap, Raster
from orelens.plans import planner

from . import components, focal, ml, sampling, stats, texture
from .components import _checkpointed
from .grid import BLOCK, complete
from .preprocess import dos1


@dataclass(frozen=True)
class FeatureResult:
    pixels: DataFrame = field(compare=False)
    names: tuple[str, ...]
    stats: DataFrame = field(compare=False)
    correlation: DataFrame = field(compare=False)
    high_correlations: DataFrame = field(compare=False)
    texture_summary: DataFrame | None = field(default=None, compare=False)


def feature_stack(pixels: DataFrame, bands: BandMap, raster: Raster, cfg: Mapping[str, Any] | None = None, enabled=None, block: int = BLOCK, dense: bool = False) -> tuple[DataFrame, list[str]]:
    """(row, col, one column a feature), and the features' names. Spectral features are one projection without a shuffle;
    terrain needs the dem's neighbours; texture is joined by tile. Only these two need every cell to be there: tables
    that are known to be `dense`, as rasters read from files are, aren't filled up first."""
    names = planner.active_features(bands, cfg, enabled)
    cfg = cfg or {}
    focal_ones = {"slope", "aspect", "roughness_proxy", *planner.GLCM} & set(names)
    grid = complete(pixels, raster.height, raster.width) if focal_ones and not dense else pixels
    if raster.dtype == "uint8" and cfg.get("drone_rgb_scale_to_float", False):
        used = {b for r in bands.__dataclass_fields__ if (b := getattr(bands, r))}
        grid = grid.withColumns({b: F.col(b) / 255.0 for b in used})
    if {"slope", "aspect", "roughness_proxy"} & set(names):
        grid = focal.terrain(grid, bands.dem, raster.res)
        if "roughness_proxy" in names:
            grid = focal.roughness(grid, "slope", raster.height, raster.width)
    made = {n: INDICES[n][0](*[F.col(getattr(bands, r)) for r in INDICES[n][1]]) for n in names if n in INDICES}
    out = grid.select("row", "col", *[made[n].alias(n) if n in made else F.col(n) for n in names if not n.startswith("glcm_")])
    wanted = [n for n in names if n.startswith("glcm_")]
    if wanted:
        band = planner.glcm_band(bands)
        tiles = texture.padded_tiles(grid, band, block, raster.height, raster.width, int(cfg.get("glcm_window_size", 7)))
        scalars = texture.glcm_directional(tiles, band, int(cfg.get("glcm_levels", 32)))
        out = texture.spread_to_pixels(out, scalars, block).drop("glcm_entropy")
        out = out.drop(*[n for n in planner.GLCM if n not in wanted])
    return out.select("row", "col", *names), names


def compute_features(pixels: DataFrame, bands: BandMap, raster: Raster, cfg: Mapping[str, Any] | None = None, enabled=None, block: int = BLOCK, dense: bool = False) -> FeatureResult:
    """The stack, checkpointed once as three reports read it, with statistics, correlation and texture summary."""
    stack, names = feature_stack(pixels, bands, raster, cfg, enabled, block, dense)
    stack = _checkpointed(stack)
    corr = stats.correlation(stack, names)
    summary, band = None, planner.summary_band(bands)
    if band:
        summary = texture.texture_summary(texture.glcm_tile(texture.tiles_of(pixels, band, block), band))
    return FeatureResult(stack, tuple(names), stats.feature_stats(stack, names), corr, stats.high_correlations(corr, float((cfg or {}).get("corr_flag_threshold", 0.95))), summary)


def postprocess_chain(pixels: DataFrame, raster: Raster, cfg: Mapping[str, Any], res_m: float, drone: bool = False, cancelled: Callable[[], bool] = lambda: False, on_step: Callable[[str], None] = lambda step: None, cls: str = "cls", conf: str = "conf", dense: bool = False) -> dict[str, DataFrame]:
    """step: class map after it, in order. Every step ends in a checkpoint; `cancelled` is asked between steps."""
    h, w, out = raster.height, raster.width, {}
    now = pixels if dense else complete(pixels, h, w)
    drone = drone or planner.is_drone(res_m, cfg)
    own = planner.drone_plan(res_m, cfg) if drone else None
    values = focal.class_values(now, cls)
    iterations = own.closing_rounds if own else max(1, int(cfg.get("morphological_iterations", 1)))
    kernel = own.closing_kernel if own else int(cfg.get("morphological_kernel_size", 3))

    def run(step, make):
        nonlocal now
        if cancelled():
            return False
        now = _checkpointed(make(now))
        out[step] = now
        on_step(step)
        return True

    def smooth(k, method):
        return lambda x: focal.median_smooth(x, cls, h, w, k, values=values) if method == "median" else focal.majority_smooth(x, cls, h, w, k, values)

    plan: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []
    if not own or own.with_confidence:
        k = own.confidence_kernel if own else 5
        plan.append(("confidence_filter", lambda x: focal.confidence_filter(x, cls, conf, h, w, float(cfg.get("confidence_threshold", 0.6)), k, values=values)))
    if own:
        plan += [(f"smooth_pass_{i}", smooth(p.kernel, p.method)) for i, p in enumerate(own.smoothing)]
    else:
        plan.append(("median_smooth", smooth(int(cfg.get("median_filter_size", 3)), "median")))
    plan += [("morphological_close" if i == iterations - 1 else f"morphological_close_{i}", lambda x: focal.morphological_close(x, cls, h, w, kernel, values)) for i in range(iterations)]
    least = own.sieve_pixels if own else components.sieve_threshold(float(cfg.get("min_mapping_unit_ha", 0.5)), res_m)
    plan.append(("sieve_filter", lambda x: components.sieve(x, cls, w, least, int(cfg.get("sieve_connectivity", 4)))))
    for step, make in plan:
        if not run(step, make):
            break
    return out


def survey(pixels: DataFrame, labels: DataFrame, bands: BandMap, raster: Raster, cfg: Mapping[str, Any], config: ml.ClassificationConfig | None = None, most: int | None = 50_000) -> dict[str, Any]:
    """Preprocess, features, samples, training, prediction, post-processing and areas of one raster."""
    used = [b for r in bands.__dataclass_fields__ if r not in ("dem", "dsm") and (b := getattr(bands, r))]
    clean = dos1(complete(pixels, raster.height, raster.width), used, raster.dtype)
    features = compute_features(clean, bands, raster, cfg, dense=True)
    names = list(features.names)
    samples = sampling.extract_from_labels(features.pixels, labels, names, most=most)
    result = ml.train(samples, names, config or ml.ClassificationConfig(), cfg)
    predicted = _checkpointed(ml.predict(result.model, features.pixels))
    res_m = raster.gsd_m or raster.res
    steps = postprocess_chain(predicted, raster, cfg, res_m, dense=True)
    final = list(steps.values())[-1]
    return {"features": features, "result": result, "predicted": predicted, "steps": steps, "areas": stats.class_areas(final, "cls", res_m), "confidence": stats.confidence_stats(predicted, "conf", float(cfg.get("confidence_threshold", 0.6)))}
