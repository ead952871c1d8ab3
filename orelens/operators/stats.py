"""Aggregates over pixel tables: feature statistics, correlation, class areas, confidence, drift."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def feature_stats(pixels: DataFrame, features: list[str]) -> DataFrame:
    """(feature, min, max, mean, std, valid_pct), each feature over its own valid pixels, zeros if it has none.

    All features in one pass: a row of aggregates, then unpivoted.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {
        "min": lambda f: zero(F.min(f)),
        "max": lambda f: zero(F.max(f)),
        "mean": lambda f: zero(F.avg(f)),
        "std": lambda f: zero(F.stddev_pop(f)),
        "valid_pct": lambda f: zero(F.try_divide(100.0 * F.count(f), F.count(F.lit(1)))),
    }
    one = pixels.agg(*[F.struct(F.lit(f).alias("feature"), *[make(f).alias(n) for n, make in parts.items()]).alias(f"_{i}") for i, f in enumerate(features)])
    return one.select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(features))])).alias("s")).select("s.*")


def correlation(pixels: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) of all ordered pairs over pixels where every feature is valid; 1 on the diagonal, 0 where a feature
    is constant, and the identity for fewer than two pixels. One aggregate row for all pairs."""
    valid = pixels.na.drop(subset=features)

    def r(a, b):
        spread = F.stddev_pop(a) * F.stddev_pop(b)  # corr() itself fails on constants in ANSI mode
        return F.when((F.count(F.lit(1)) < 2) | (spread <= 1e-12), 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0)))

    pairs = list(combinations(features, 2))
    one = valid.agg(*[r(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]) if pairs else valid.agg(F.lit(0).alias("_none"))
    cell = lambda a, b, v: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("r"))
    cells = [cell(x, y, F.col(f"_{i}")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    cells += [cell(f, f, F.lit(1.0)) for f in features]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def high_correlations(corr: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs, each once, whose coefficient is beyond the threshold; at it is not beyond."""
    return corr.where((F.col("a") < F.col("b")) & (F.abs("r") > threshold))


def class_areas(classes: DataFrame, cls: str, res_m: float | None) -> DataFrame:
    """(class_id, pixel_count, area_ha, area_pct); invalid pixels don't count."""
    if res_m is None:
        raise ValueError("areas need a pixel size in metres: the reference system is geographic")
    counts = classes.where(F.col(cls).isNotNull()).groupBy(F.col(cls).cast("int").alias("class_id")).agg(F.count("*").alias("pixel_count"))
    area = F.col("pixel_count") * (res_m * res_m / 10000.0)
    return with_area_pct(counts.withColumn("area_ha", area))


def with_area_pct(areas: DataFrame) -> DataFrame:
    total = F.sum("area_ha").over(Window.partitionBy())  # one row a class
    return areas.withColumn("area_pct", F.when(total > 0, 100.0 * F.col("area_ha") / total).otherwise(0.0))


def nodata_fraction(areas: DataFrame, height: int, width: int) -> DataFrame:
    n = float(height * width)
    return areas.agg(((n - F.coalesce(F.sum("pixel_count"), F.lit(0))) / n).alias("nodata_fraction"))


def exact_quantiles(df: DataFrame, column: str, points: list[float], bins: int = 1024) -> list[float | None]:
    """Interpolated quantiles of the non-NULL values, exact at any size.

    An order statistic is found by narrowing: values between two bounds are counted in bins, and the bin that holds the
    rank gives the next bounds, its least and largest value. A pass reads the column once, for all ranks, and brings a
    row a bin to the driver; bounds meet after a few passes. Nothing is sorted or gathered, unlike with percentile().
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(points)
    places = [p * (n - 1) for p in points]
    open_ = {r: (low, high, 0) for x in places for r in (int(x), min(int(x) + 1, n - 1))}  # rank: bounds, values below them
    found = {}
    while open_:
        for r in [r for r, (a, b, _) in open_.items() if a == b]:
            found[r] = open_.pop(r)[0]
        spans = sorted(set(open_.values()))
        if not spans:
            break
        v = F.col("v")
        at = [F.when(v.between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.lit(bins - 1), F.floor((v - a) / (b - a) * bins)).alias("bin"))) for i, (a, b, _) in enumerate(spans)]
        counted = values.withColumn("p", F.explode(F.array_compact(F.array(*at)))).groupBy("p.i", "p.bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sorted(counted.collect(), key=lambda r: (r.i, r.bin))
        for rank, span in list(open_.items()):
            below = span[2]
            for row in (r for r in rows if r.i == spans.index(span)):
                if below + row.n > rank:
                    open_[rank] = (row.lo, row.hi, below)
                    break
                below += row.n
    out = []
    for x in places:
        lo, hi = found[int(x)], found[min(int(x) + 1, n - 1)]
        out.append(lo + (hi - lo) * (x - int(x)))
    return out


def confidence_stats(pixels: DataFrame, conf: str, threshold: float = 0.6, approximate: bool = False) -> DataFrame:
    """One row: mean, min, max, p05, p50, p95, n_valid, n_above, pct_above, n_below, pct_below over values from 0."""
    valid, c = pixels.where(F.col(conf) >= 0), F.col(conf)
    names, points = ("p05", "p50", "p95"), [0.05, 0.5, 0.95]
    if approximate:
        quantiles = F.percentile_approx(c, points, 10000)
    else:
        quantiles = F.array(*[F.lit(x).cast("double") for x in exact_quantiles(valid, conf, points)])
    above, below, n = F.count_if(c >= threshold), F.count_if(c < threshold), F.count(F.lit(1))
    one = valid.agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), (quantiles if approximate else F.first(quantiles)).alias("q"), n.alias("n_valid"), above.alias("n_above"), F.try_divide(100.0 * above, n).alias("pct_above"), below.alias("n_below"), F.try_divide(100.0 * below, n).alias("pct_below"))
    return one.select("mean", "min", "max", *[F.get("q", i).alias(name) for i, name in enumerate(names)], "n_valid", "n_above", "pct_above", "n_below", "pct_below")


def class_summary(samples: DataFrame, label: str) -> DataFrame:
    """(class, count, percentage), the percentage to two decimals."""
    counts = samples.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 2))


def is_imbalanced(samples: DataFrame, label: str, threshold_pct: float = 10.0) -> DataFrame:
    """One row: whether some class holds less than the threshold."""
    counts = samples.groupBy(label).agg(F.count("*").alias("n"))
    share = counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.agg(F.coalesce(F.bool_or(F.col("pct") < threshold_pct), F.lit(False)).alias("imbalanced"))


def drift(current: DataFrame, previous: DataFrame, alert_pct: float = 20.0) -> DataFrame:
    """(class_id, pct_change, is_new, flagged) of classes in both runs. A class that had no area and now has some is new,
    flagged, and has a NULL change; a change of just the threshold is flagged."""
    joined = current.select("class_id", F.col("area_ha").alias("now")).join(previous.select("class_id", F.col("area_ha").alias("was")), "class_id")
    new = (F.col("was") == 0) & (F.col("now") > 0)
    pct = F.when(F.col("was") != 0, (F.col("now") - F.col("was")) / F.col("was") * 100.0).when(F.col("now") == 0, 0.0)
    out = joined.withColumns({"pct_change": pct, "is_new": new})
    return out.select("class_id", "pct_change", "is_new", (F.col("is_new") | F.coalesce(F.abs("pct_change") >= alert_pct, F.lit(False))).alias("flagged"))


def drift_text(pct: Column, is_new: Column) -> Column:
    return F.when(is_new, "∞ (new class)").otherwise(F.format_string("%+.1f%%", pct))


def survey_area(width: int, height: int, res: float, projected: bool = True) -> float:
    """Hectares; degrees count as 111,320 m."""
    res_m = abs(res) * (1.0 if projected else 111_320.0)
    return width * height * res_m * res_m / 10000.0


def shift_stats(points: DataFrame) -> DataFrame:
    """One row of tie-point shifts (x_shift, y_shift, abs_shift): means, magnitude of the mean shift, mean length."""
    x, y = F.avg("x_shift"), F.avg("y_shift")
    return points.agg(x.alias("shift_x"), y.alias("shift_y"), F.hypot(x, y).alias("shift_magnitude"), F.avg("abs_shift").alias("rmse"))
