"""Schemas, band roles, configuration and small results shared by the operators.

A raster is a pixel table: one row per pixel with `row`, `col` (and `layer` where several rasters share a table) and
one DOUBLE column per band or feature. Nodata, NaN and infinities are NULL from the source on.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

#: Default thresholds of the workflow.
DEFAULTS: dict[str, Any] = {
    "coreg_rmse_threshold": 0.5,
    "min_oa_threshold": 0.80,
    "min_minority_f1": 0.70,
    "quality_gate_oa_pass": 0.90,
    "quality_gate_oa_fail": 0.80,
    "quality_gate_kappa_pass": 0.80,
    "quality_gate_kappa_fail": 0.65,
    "quality_gate_f1_pass": 0.70,
    "quality_gate_f1_fail": 0.50,
    "quality_gate_confidence_pass": 0.75,
    "quality_gate_confidence_fail": 0.60,
    "quality_gate_nodata_pass": 0.05,
    "quality_gate_nodata_fail": 0.10,
    "drift_alert_pct": 20,
    "min_mapping_unit_ha": 0.5,
    "confidence_threshold": 0.6,
    "median_filter_size": 3,
    "morphological_kernel_size": 3,
    "morphological_iterations": 1,
    "sieve_connectivity": 4,
    "drone_pixel_res_threshold_m": 1.0,
    "drone_morpho_iterations": 2,
    "drone_smooth_target_fine_m": 0.3,
    "drone_smooth_target_medium_m": 1.5,
    "drone_smooth_target_coarse_m": 3.0,
    "drone_morpho_target_m": 0.75,
    "drone_sieve_target_m2": 1.0,
    "drone_max_median_kernel": 31,
    "drone_max_morpho_kernel": 11,
    "drone_block_size": 256,
    "drone_rgb_scale_to_float": True,
    "default_k_folds": 5,
    "smote_auto_threshold_pct": 10,
    "max_date_gap_days": 30,
    "min_overlap_pct": 80.0,
    "max_resolution_ratio": 2.0,
    "phenology_month_gap": 2,
    "corr_flag_threshold": 0.95,
    "glcm_window_size": 7,
    "glcm_levels": 32,
    "sar_enl_default": 1.0,
    "sar_enl_sentinel1_iw": 4.9,
    "mining_features_enabled": True,
}


def load_config(path: str | Path | None = None, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, overlaid key by key by a YAML file (which may be missing) and then by `overrides`."""
    out = dict(DEFAULTS)
    if path is not None and Path(path).is_file():
        import yaml

        out |= yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return out | dict(overrides or {})


@dataclass(frozen=True)
class BandMap:
    """Which column of a pixel table plays which spectral role; None where there is none."""

    nir: str | None = None
    red: str | None = None
    green: str | None = None
    blue: str | None = None
    swir: str | None = None
    rededge: str | None = None
    vv: str | None = None
    vh: str | None = None
    dem: str | None = None
    dsm: str | None = None

    def has(self, *roles: str) -> bool:
        return all(getattr(self, r) for r in roles)

    @classmethod
    def of(cls, columns) -> "BandMap":
        """Roles played by columns that are named after them."""
        return cls(**{f.name: f.name for f in fields(cls) if f.name in columns})


@dataclass(frozen=True)
class Raster:
    """Geometry that pixel tables don't carry: size, pixel size, origin (top left) and reference system."""

    width: int
    height: int
    res: float = 1.0
    x_origin: float = 0.0
    y_origin: float = 0.0
    epsg: int | None = None
    dtype: str = "float32"
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def projected(self) -> bool:
        return self.epsg is not None and self.epsg != 4326

    @property
    def gsd_m(self) -> float | None:
        """Metres a pixel, where the reference system is projected."""
        return abs(self.res) if self.projected else None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top"""
        return self.x_origin, self.y_origin - self.height * self.res, self.x_origin + self.width * self.res, self.y_origin
