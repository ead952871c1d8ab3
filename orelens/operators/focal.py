"""Neighbourhoods: terrain derivatives, median and majority filters, closing, confidence-guided smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import along_col, along_row, inside, layer_of, pad
from .preprocess import _odd, box_sums


def _gradient(value: str, window, res: float) -> Column:
    """Central differences inside, one-sided at the ends; an invalid neighbour makes the result invalid."""
    step = max(res, 1e-9)
    before, here, after = F.lag(value).over(window), F.col(value), F.lead(value).over(window)
    first, last = F.lag(F.lit(1)).over(window).isNull(), F.lead(F.lit(1)).over(window).isNull()
    return F.when(first & last, None).when(first, (after - here) / step).when(last, (here - before) / step).otherwise((after - before) / (2 * step))


def gradients(pixels: DataFrame, dem: str, res: float) -> DataFrame:
    layer = layer_of(pixels)
    return pixels.withColumns({"dx": _gradient(dem, along_row(*layer), res)}).withColumns({"dy": _gradient(dem, along_col(*layer), res)})


def terrain(pixels: DataFrame, dem: str, res: float) -> DataFrame:
    """pixels with `slope` (rise over run) and `aspect` (degrees from east, counter-clockwise, in [0, 360))."""
    g = gradients(pixels, dem, res)
    known = F.col(dem).isNotNull()
    slope = F.when(known, F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    aspect = F.when(known, F.pmod(F.degrees(F.atan2(-F.col("dy"), F.col("dx"))), F.lit(360.0)))
    return g.withColumns({"slope": slope, "aspect": aspect}).drop("dx", "dy")


def roughness(pixels: DataFrame, slope: str, height: int, width: int) -> DataFrame:
    """pixels with `roughness_proxy`: 3 x 3 population deviation of the slope over valid cells, edges repeated."""
    s = F.col(slope)
    sums = box_sums(pad(pixels, height, width, 1, "nearest"), {"_n": F.when(s.isNotNull(), 1.0).otherwise(0.0), "_s": F.coalesce(s, F.lit(0.0)), "_q": F.coalesce(s * s, F.lit(0.0))}, 3)
    mean = F.col("_s") / F.col("_n")
    spread = F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0)))
    return inside(sums, height, width).withColumn("roughness_proxy", F.when(F.col(slope).isNotNull(), spread)).drop("_n", "_s", "_q")


def _with_median(classes: DataFrame, cls: str, k: int, height: int, width: int, nodata: int, values: list[int] | None) -> DataFrame:
    """classes with `_median` of k x k cells; invalid cells take part as `nodata`, borders repeat the edge (symmetric).

    A class map has few values, so the median is where the running votes pass the half: box sums of one indicator a
    value, whose cost doesn't depend on k, and no list of neighbours is ever built.
    """
    values = sorted({nodata, *(class_values(classes, cls) if values is None else values)})
    own = F.coalesce(F.col(cls).cast("int"), F.lit(nodata))
    votes = {f"_v{i}": F.when(own == v, 1).otherwise(0) for i, v in enumerate(values)}
    sums = inside(box_sums(pad(classes, height, width, _odd(k) // 2, "symmetric"), votes, k), height, width)
    upto, median = F.lit(0), None
    for i, v in enumerate(values):
        upto = upto + F.col(f"_v{i}")
        reached = upto > k * k // 2
        median = F.when(reached, v) if median is None else median.when(reached, v)
    return sums.withColumn("_median", median).drop(*votes)


def median_smooth(classes: DataFrame, cls: str, height: int, width: int, k: int = 3, nodata: int = -1, values: list[int] | None = None) -> DataFrame:
    out = _with_median(classes, cls, k, height, width, nodata, values)
    return out.withColumn(cls, F.when(F.col(cls).isNotNull(), F.col("_median"))).drop("_median")


def with_confidence(classes: DataFrame, confidence: DataFrame, conf: str, class_raster, conf_raster) -> DataFrame:
    """A class table with the confidence of another raster of the same size; cells without one have NULL."""
    sizes = [(r.height, r.width) for r in (class_raster, conf_raster)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"classes are {sizes[0]} pixels, confidence is {sizes[1]}")
    keys = [*layer_of(classes), "row", "col"]
    return classes.drop(conf).join(confidence.select(*keys, conf), keys, "left")


def confidence_filter(classes: DataFrame, cls: str, conf: str, height: int, width: int, threshold: float = 0.6, k: int = 5, nodata: int = -1, values: list[int] | None = None) -> DataFrame:
    """Classes of low confidence take the median of the original classes around them."""
    doubtful = F.col(cls).isNotNull() & (F.col(conf) >= 0) & (F.col(conf) < threshold)
    out = _with_median(classes, cls, k, height, width, nodata, values)
    return out.withColumn(cls, F.when(doubtful, F.col("_median")).otherwise(F.col(cls))).drop("_median")


def class_values(classes: DataFrame, cls: str) -> list[int]:
    """The distinct classes, ascending; a class map has few, and their number is checked."""
    found = sorted(r[0] for r in classes.where(F.col(cls).isNotNull()).select(F.col(cls).cast("int")).distinct().limit(1025).collect())
    if len(found) > 1024:
        raise ValueError("more than 1024 classes: not a class map")
    return found


def majority_filter(classes: DataFrame, cls: str, height: int, width: int, k: int = 3, values: list[int] | None = None) -> DataFrame:
    """The most frequent class of k x k cells, the smallest if several are; edges repeat, invalid cells have no vote
    and stay invalid. Votes are box sums of one indicator a class, whose cost doesn't depend on k."""
    _odd(k)
    values = class_values(classes, cls) if values is None else values
    if not values:
        return classes
    votes = {f"_v{i}": F.when(F.col(cls) == v, 1).otherwise(0) for i, v in enumerate(values)}
    sums = inside(box_sums(pad(classes, height, width, k // 2, "nearest"), votes, k), height, width)
    best = F.array_max(F.array(*[F.struct(F.col(f"_v{i}").alias("n"), F.lit(-v).alias("v")) for i, v in enumerate(values)]))
    return sums.withColumn(cls, F.when(F.col(cls).isNotNull(), -best["v"])).drop(*votes)


def majority_smooth(classes: DataFrame, cls: str, height: int, width: int, k: int = 9, values: list[int] | None = None) -> DataFrame:
    return majority_filter(classes, cls, height, width, k, values)


def morphological_close(classes: DataFrame, cls: str, height: int, width: int, k: int = 3, values: list[int] | None = None) -> DataFrame:
    """Two majority passes over the whole raster."""
    once = majority_filter(classes, cls, height, width, k, values)
    return majority_filter(once, cls, height, width, k, values)
