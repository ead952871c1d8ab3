"""Preprocessing: dark-object subtraction, box sums and the Lee speckle filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orelens.functions.indices import subtract_dark

from .grid import BLOCK, along_col, along_row, by_layer, inside, layer_of, pad


def dark_object_values(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """One row (a layer): each band's smallest positive value, 0 where there is none."""
    return pixels.groupBy(*layer_of(pixels)).agg(*[F.coalesce(F.min(F.when(F.col(b) > 0, F.col(b))), F.lit(0.0)).alias(b) for b in bands])


def dos1(pixels: DataFrame, bands: list[str], dtype: str | None = None) -> DataFrame:
    """Dark-object subtraction: one aggregate row (a layer) joined back."""
    dark = dark_object_values(pixels, bands).select(*layer_of(pixels), *[F.col(b).alias(f"_dark_{b}") for b in bands])
    joined = by_layer(pixels, dark)
    out = joined.withColumns({b: subtract_dark(F.col(b), F.col(f"_dark_{b}"), dtype) for b in bands})
    return out.drop(*[f"_dark_{b}" for b in bands])


def band_means(pixels: DataFrame, bands: list[str], width: int, block: int = BLOCK, tiles: int = 4) -> DataFrame:
    """One row (a layer): each band's mean over the first tiles in row-major order; 1 where it isn't positive."""
    across = -(-width // block)
    tile = F.floor(F.col("row") / block) * across + F.floor(F.col("col") / block)
    mean = lambda b: F.avg(b)
    return pixels.where(tile < tiles).groupBy(*layer_of(pixels)).agg(*[F.when(mean(b) > 0, mean(b)).otherwise(1.0).alias(b) for b in bands])


def integral_image(pixels: DataFrame, value: str) -> DataFrame:
    """Sums over all cells above and to the left, own cell included."""
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    rows = pixels.withColumn("integral", F.sum(value).over(so_far(along_row(*layer_of(pixels)))))
    return rows.withColumn("integral", F.sum("integral").over(so_far(along_col(*layer_of(pixels)))))


def box_sums(pixels: DataFrame, values: dict[str, Column], k: int) -> DataFrame:
    """k x k sums around each cell, over the cells that are there: a window along rows, then one along columns."""
    p, layer = k // 2, layer_of(pixels)
    rows = pixels.withColumns({n: F.sum(v).over(along_row(*layer).rangeBetween(-p, p)) for n, v in values.items()})
    return rows.withColumns({n: F.sum(n).over(along_col(*layer).rangeBetween(-p, p)) for n in values})


def _odd(k: int) -> int:
    if not isinstance(k, int) or isinstance(k, bool) or k < 3 or k % 2 == 0:
        raise ValueError(f"a kernel must be an odd whole number from 3, not {k!r}")
    return k


def local_mean_var(pixels: DataFrame, value: str, k: int, height: int, width: int) -> DataFrame:
    """pixels with `mean` and `var` of the k x k cells around each, mirrored at the border without the edge."""
    _odd(k)
    v = F.col(value)
    sums = box_sums(pad(pixels, height, width, k // 2, "mirror"), {"_s": v, "_q": v * v}, k)
    n = float(k * k)
    out = inside(sums, height, width).withColumn("mean", F.col("_s") / n)
    return out.withColumn("var", F.greatest(F.col("_q") / n - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("_s", "_q")


def lee_filter(pixels: DataFrame, value: str, height: int, width: int, k: int = 7, enl: float = 1.0, block: int = BLOCK) -> DataFrame:
    """pixels with `value` despeckled: local mean plus a weight times the difference from it. Invalid cells count as
    the band's mean around them and stay invalid."""
    mean = band_means(pixels, [value], width, block).select(*layer_of(pixels), F.col(value).alias("_band"))
    filled = by_layer(pixels, mean).withColumn("_x", F.coalesce(value, "_band"))
    local = local_mean_var(filled, "_x", k, height, width)
    noise = F.pow(F.col("mean") / max(enl, 1e-6), F.lit(2.0))
    weight = F.when(F.col("var") + noise > 0, F.col("var") / (F.col("var") + noise)).otherwise(0.0)
    smooth = F.col("mean") + weight * (F.col("_x") - F.col("mean"))
    return local.withColumn(value, F.when(F.col(value).isNotNull(), smooth)).drop("_x", "_band", "mean", "var")
