"""Synthetic label rasters for demonstrations: an open pit and a tailings facility, as expressions over a range.

Zones follow a distance from the site's centre, bent by smooth noise. The noise is the usual sum of octaves of values on
a lattice, here hashes of the lattice points, so any pixel is computed on its own, anywhere, and always alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OCTAVES = (1, 2, 4, 8)
#: Centre and reach of each site as shares of its height and width, how far noise bends the zones, and the
#: zones' limits as distances from the centre.
PIT = {"centre": (0.55, 0.5), "reach": (0.5, 0.5), "bend": 0.15, "crest": 0.78, "slope": 0.45, "band": (0.42, 0.50), "band_noise": 0.45, "pond_row": 0.70, "pond_sigma": 0.07, "pond_level": 0.55, "pond_within": 0.25}
TAILINGS = {"centre": (0.45, 0.5), "reach": (0.48, 0.52), "bend": 0.12, "wet": 0.30, "beach": 0.72, "pond": 0.12, "pond_row": 0.55, "toe": (0.68, 0.80), "toe_noise": 0.55, "face": (0.22, 0.50), "face_col": 0.55, "face_noise": 0.60}


def noise(row: Column, col: Column, height: int, width: int, pixels: int, seed: int) -> Column:
    """Smooth values in [0, 1]; the coarsest octave has a lattice point every height / (height / pixels) pixels."""
    total, weight = F.lit(0.0), 0.0
    for k, octave in enumerate(OCTAVES):
        across = [max(1, n * octave // pixels) for n in (height, width)]
        u, v = (x * (n / size) for x, n, size in zip((row, col), across, (height, width)))
        i, j = F.floor(u), F.floor(v)
        s, t = u - i, v - j

        def corner(a, b, i=i, j=j, k=k):
            return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i + a, j + b), F.lit(1_000_003)) / 1_000_003.0

        value = (corner(0, 0) * (1 - t) + corner(0, 1) * t) * (1 - s) + (corner(1, 0) * (1 - t) + corner(1, 1) * t) * s
        total, weight = total + value * 0.5**k, weight + 0.5**k
    return total / weight


def _grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def _distance(height: int, width: int, centre: tuple[float, float], reach: tuple[float, float]) -> Column:
    y = (F.col("row") - height * centre[0]) / (height * reach[0])
    x = (F.col("col") - width * centre[1]) / (width * reach[1])
    return F.sqrt(y * y + x * x)


def _zones(cells: DataFrame, rules: list[tuple[Column, int]], default: int) -> DataFrame:
    """(row, col, label) by the first rule that holds."""
    label = F
    for holds, value in rules:
        label = label.when(holds, value)
    return cells.select("row", "col", label.otherwise(default).cast("int").alias("label"))


def _bent(spark: SparkSession, height: int, width: int, site: dict, seed: int, **grains: int) -> DataFrame:
    """Cells with the bent distance `d` and one noise a name in `grains`."""
    row, col = F.col("row"), F.col("col")
    smooth = lambda pixels, k: noise(row, col, height, width, pixels, seed + k)
    more = {name: smooth(pixels, k) for k, (name, pixels) in enumerate(grains.items(), 1)}
    return _grid(spark, height, width).withColumns({"d": _distance(height, width, site["centre"], site["reach"]) + site["bend"] * (smooth(8, 0) - 0.5), **more})


def _between(value: Column, limits: tuple[float, float]) -> Column:
    return (value > limits[0]) & (value <= limits[1])


def pit_wall_labels(spark: SparkSession, height: int, width: int, seed: int = 42) -> DataFrame:
    """1 fresh rock, 2 weathered slope, 3 unstable band, 4 vegetation at the crest, 5 water on the floor."""
    d, site = F.col("d"), PIT
    away = F.pow(F.col("row") - height * site["pond_row"], F.lit(2.0)) + F.pow(F.col("col") - width * site["centre"][1], F.lit(2.0))
    water = F.exp(-away / (2 * (height * site["pond_sigma"]) ** 2)) > site["pond_level"]
    rules = [(water & (d < site["pond_within"]), 5), (_between(d, site["band"]) & (F.col("loose") > site["band_noise"]), 3), (d > site["crest"], 4), (d > site["slope"], 2)]
    return _zones(_bent(spark, height, width, site, seed, loose=4), rules, 1)


def tailings_labels(spark: SparkSession, height: int, width: int, seed: int = 42) -> DataFrame:
    """1 wet tailings, 2 dry beach, 3 pond, 4 rehabilitated crest, 5 dust risk down wind, 6 seepage at the toe."""
    d, site = F.col("d"), TAILINGS
    rules = [
        (_between(d, site["face"]) & (F.col("col") > width * site["face_col"]) & (F.col("dust") > site["face_noise"]), 5),
        (_between(d, site["toe"]) & (F.col("seep") > site["toe_noise"]), 6),
        ((d <= site["pond"]) & (F.col("row") > height * site["pond_row"]), 3),
        (d <= site["wet"], 1),
        (d <= site["beach"], 2),
    ]
    return _zones(_bent(spark, height, width, site, seed, seep=6, dust=5), rules, 4)


def ring_labels(spark: SparkSession, height: int, width: int, classes: int = 5, seed: int = 42) -> DataFrame:
    """Rings around the centre, with a tenth of the pixels moved to a neighbouring class by hash."""
    far = _distance(height, width, (0.5, 0.5), (1.0, 1.0)) / 0.7072
    ring = F.least(F.floor(far * classes), F.lit(classes - 1)) + 1
    drawn = F.pmod(F.xxhash64(F.lit(seed), "row", "col"), F.lit(100))
    moved = F.when(drawn < 5, F.greatest(ring - 1, F.lit(1))).when(drawn < 10, F.least(ring + 1, F.lit(classes))).otherwise(ring)
    return _grid(spark, height, width).select("row", "col", moved.cast("int").alias("label"))
