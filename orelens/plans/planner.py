"""Planning in plain Python: which features a band map allows, and how post-processing scales with pixel size."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from orelens.functions.indices import INDICES
from orelens.model import BandMap

GLCM = ("glcm_contrast", "glcm_homogeneity", "glcm_correlation")
#: Order of the base features and of the optional ones.
BASE = ("ndvi", "ndwi", "bsi", "ndre", "vari", "sar_ratio", "slope", "aspect")
MULTISPECTRAL = ("iron_oxide", "clay_index", "ferrous", "mndwi")
RGB = ("exg", "exr", "brightness", "hue", "saturation")


def _possible(name: str, bands: BandMap) -> bool:
    if name in ("slope", "aspect", "roughness_proxy"):
        return bands.has("dem")
    return bands.has(*INDICES[name][1])


def rgb_only(bands: BandMap) -> bool:
    return bands.has("red", "green", "blue") and not bands.nir and not bands.swir


def base_features(bands: BandMap) -> list[str]:
    out = [n for n in BASE if _possible(n, bands)]
    return out + list(GLCM) * any(bands.has(r) for r in ("nir", "red", "green", "blue"))


def mining_features(bands: BandMap, only_rgb: bool = False) -> list[str]:
    wide = () if only_rgb else (*MULTISPECTRAL, "roughness_proxy")
    return [n for n in (*wide, *RGB) if _possible(n, bands)]


def active_features(bands: BandMap, cfg: Mapping[str, Any] | None = None, enabled: Iterable[str] | None = None) -> list[str]:
    """Ordered features to compute. Optional ones need a configuration that was passed on purpose and allows them, or
    RGB imagery without other bands, or to be enabled by name; `enabled` selects but doesn't reorder."""
    optional = mining_features(bands, rgb_only(bands))
    out = base_features(bands)
    if cfg is not None and (cfg.get("mining_features_enabled", False) or rgb_only(bands)):
        out += optional
    if enabled is not None:
        wanted = set(enabled)
        out += [n for n in optional if n in wanted and n not in out]
        out = [n for n in out if n in wanted]
    if not out:
        raise ValueError("the band map allows no feature: assign at least two bands, such as nir and red")
    return out


def glcm_band(bands: BandMap) -> str | None:
    """The band whose spatial texture is measured."""
    return bands.nir or bands.red or bands.green or bands.blue


def summary_band(bands: BandMap, first: str | None = None) -> str | None:
    """The band whose texture is summarised tile by tile; in another order than glcm_band()."""
    return bands.red or bands.nir or bands.vv or first


def adaptive_kernel_size(res_m: float, ground_m: float, least: int = 3, most: int = 51) -> int:
    """Pixels to cover a ground distance, made odd and then held within limits."""
    return max(least, min(most, math.ceil(ground_m / max(res_m, 1e-6)) // 2 * 2 + 1))


@dataclass(frozen=True)
class Smoothing:
    """One smoothing pass, as ground to cover: its setting and default in metres, limits of the kernel (the upper one
    may be a setting), the kernel beyond which votes take the median's place, and the pixel size from which it's idle."""

    what: str
    setting: str
    ground_m: float
    least: int
    most: int | tuple[str, int]
    votes_beyond: float
    idle_from_m: float = math.inf


@dataclass(frozen=True)
class Pass:
    what: str
    kernel: int
    method: str


@dataclass(frozen=True)
class DronePlan:
    """Post-processing that covers the same ground at any pixel size."""

    smoothing: tuple[Pass, ...]
    closing_kernel: int
    closing_rounds: int
    confidence_kernel: int
    sieve_pixels: int
    with_confidence: bool


_WIDEST = ("drone_max_median_kernel", 31)
#: Settings, defaults and limits of the passes, from the finest on.
SMOOTHING = (
    Smoothing("single pixels", "drone_smooth_target_fine_m", 0.3, 3, 7, math.inf),
    Smoothing("small patches", "drone_smooth_target_medium_m", 1.5, 5, _WIDEST, 7),
    Smoothing("parts of objects", "drone_smooth_target_coarse_m", 3.0, 9, _WIDEST, 0, idle_from_m=0.3),
)


def drone_plan(res_m: float, cfg: Mapping[str, Any]) -> DronePlan:
    """A pass runs if its kernel is wider than the one before it in SMOOTHING would be."""
    setting = lambda key, default: type(default)(cfg.get(key, default))
    passes, before = [], 0
    for s in SMOOTHING:
        kernel = adaptive_kernel_size(res_m, setting(s.setting, s.ground_m), s.least, setting(*s.most) if isinstance(s.most, tuple) else s.most)
        if kernel > before and res_m < s.idle_from_m:
            passes.append(Pass(s.what, kernel, "majority" if kernel > s.votes_beyond else "median"))
        before = kernel
    rounds = math.ceil(0.5 / max(res_m, 0.05))
    return DronePlan(
        smoothing=tuple(passes),
        closing_kernel=adaptive_kernel_size(res_m, setting("drone_morpho_target_m", 0.75), 3, setting("drone_max_morpho_kernel", 11)),
        closing_rounds=max(2, min(4, rounds)),
        confidence_kernel=adaptive_kernel_size(res_m, 0.5, 5, 15) // 2 * 2 + 1,
        sieve_pixels=max(50, int(setting("drone_sieve_target_m2", 1.0) / res_m**2)),
        with_confidence=res_m >= 0.5,
    )


def is_drone(res_m: float, cfg: Mapping[str, Any]) -> bool:
    return res_m < float(cfg.get("drone_pixel_res_threshold_m", 1.0))


def chain_steps(res_m: float, cfg: Mapping[str, Any], drone: bool = False) -> list[tuple[str, str]]:
    """(key, label) of the post-processing steps in order."""
    smooth = [("median_smooth", "median of classes")]
    if drone or is_drone(res_m, cfg):
        smooth = [(f"smooth_pass_{i}", f"{p.method} over {p.what}, {p.kernel} pixels") for i, p in enumerate(drone_plan(res_m, cfg).smoothing)]
    return [("confidence_filter", "doubtful pixels"), *smooth, ("morphological_close", "closing by votes"), ("sieve_filter", "least mapping unit")]


#: Seconds a pixel of each step, as published.
STEP_SECONDS = {"confidence_filter": 0.8e-6, "median_smooth": 1.2e-6, "morphological_close": 0.6e-6, "sieve_filter": 0.4e-6}


def estimate_chain_time(pixels: int, cfg: Mapping[str, Any], res_m: float) -> dict[str, float | str]:
    """Seconds by step, and a `warning` if they add to more than five minutes."""
    drone = is_drone(res_m, cfg)
    times = {"confidence_filter": 0 if drone and res_m < 0.5 else 1, "morphological_close": max(1, int(cfg.get("drone_morpho_iterations", 2) if drone else cfg.get("morphological_iterations", 1)))}
    out: dict[str, float | str] = {k: pixels * s * times.get(k, 1) for k, s in STEP_SECONDS.items()}
    total = sum(out.values())
    if total > 300:
        out["warning"] = f"{pixels:,} pixels take about {math.ceil(total / 60)} minutes"
    return out
