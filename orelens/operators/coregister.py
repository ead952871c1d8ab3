"""Coregistration: a stub that reports no shift, and global phase correlation between two bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelens.sources.geotiff import write_raster

from .gates import rmse_gate
from .grid import inside
from .stats import shift_stats

SCHEMA = "shift_x double, shift_y double, shift_magnitude double, rmse double, corrected_path string, message string, is_stub boolean"


def stub(spark, target_path: str) -> DataFrame:
    return spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, target_path, "No coregistration backend: the target is passed on as it is.", True)], SCHEMA)


def tile_shifts(reference: DataFrame, target: DataFrame, ref_band: str, tgt_band: str, block: int = 64) -> DataFrame:
    """(tile_r, tile_c, x_shift, y_shift, abs_shift): how far the target's content lies from the reference's, in pixels,
    by the peak of each tile's normalised cross-power spectrum."""
    tile = [F.floor(F.col(c) / block).cast("int").alias(t) for c, t in (("row", "tile_r"), ("col", "tile_c"))]
    both = reference.select("row", "col", F.col(ref_band).alias("a")).join(target.select("row", "col", F.col(tgt_band).alias("b")), ["row", "col"])

    def shift(t: pd.DataFrame) -> pd.DataFrame:
        r, c = t["row"].to_numpy() % block, t["col"].to_numpy() % block
        x, y = np.zeros((block, block)), np.zeros((block, block))
        x[r, c], y[r, c] = t["a"].fillna(t["a"].mean()), t["b"].fillna(t["b"].mean())
        cross = np.fft.fft2(y - y.mean()) * np.conj(np.fft.fft2(x - x.mean()))
        peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
        dy, dx = np.unravel_index(np.argmax(peak), peak.shape)
        dy, dx = (int(v) - block if v > block // 2 else int(v) for v in (dy, dx))
        return pd.DataFrame({"tile_r": [t["tile_r"].iloc[0]], "tile_c": [t["tile_c"].iloc[0]], "x_shift": [float(dx)], "y_shift": [float(dy)], "abs_shift": [float(np.hypot(dx, dy))]})

    return both.select(*tile, "row", "col", "a", "b").groupBy("tile_r", "tile_c").applyInPandas(shift, "tile_r int, tile_c int, x_shift double, y_shift double, abs_shift double")


def coregister(reference: DataFrame, target: DataFrame, ref_band: str, tgt_band: str, target_path: str, threshold: float = 0.5, use_stub: bool = False) -> DataFrame:
    """One gated result row."""
    if use_stub:
        return rmse_gate(stub(reference.sparkSession, target_path), threshold)
    shifts = shift_stats(tile_shifts(reference, target, ref_band, tgt_band))
    out = shifts.select("shift_x", "shift_y", "shift_magnitude", "rmse", F.lit(target_path).alias("corrected_path"), F.lit("Phase correlation by tiles.").alias("message"), F.lit(False).alias("is_stub"))
    return rmse_gate(out, threshold)


def corrected(target: DataFrame, result: DataFrame, height: int, width: int) -> DataFrame:
    """The target moved back by the whole pixels of a result row's shift. A projection: values stay as they are, and what
    leaves the raster is dropped; the fraction that is left is at most half a pixel a direction."""
    found = result.first()
    back = lambda c, by: (F.col(c).cast("int") - int(round(by or 0.0))).alias(c)
    rest = [c for c in target.columns if c not in ("row", "col")]
    return inside(target.select(back("row", found.shift_y), back("col", found.shift_x), *rest), height, width)


def coregister_to(reference: DataFrame, target: DataFrame, ref_band: str, tgt_band: str, path: str, raster, threshold: float = 0.5) -> DataFrame:
    """The gated result row; if it passes, the corrected raster is written to `path`."""
    result = coregister(reference, target, ref_band, tgt_band, path, threshold)
    found = target.sparkSession.createDataFrame([result.first()], result.schema)
    if found.first().gate_passed:
        write_raster(corrected(target, found, raster.height, raster.width), path, raster, raster.dtype)
    return found


def shift_report(result: DataFrame) -> DataFrame:
    return result.select(*[F.round(c, 4).alias(c) for c in ("shift_x", "shift_y", "shift_magnitude", "rmse")], "gate_passed", "is_stub", "message")
