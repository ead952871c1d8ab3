"""Grey-level co-occurrence texture, one set of scalars a tile.

Pixels are dealt out by tile once. Grey levels, neighbours in each direction (windows over rows, columns and the two
diagonals of a tile) and the co-occurrence counts all keep that partitioning, so a texture costs one shuffle. A tile has
a fixed size, which bounds every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TILE = ("tile_r", "tile_c")
#: Lines along which the neighbour at an angle is the one before (in rows, or in columns for 0 degrees).
LINES = {0: ("row", "col"), 45: ("_sum", "row"), 90: ("col", "row"), 135: ("_diff", "row")}


def _levels(tiles: DataFrame, value: str, levels: int) -> DataFrame:
    """tiles with grey level q, and whether their tile is flat; invalid cells take the tile's mean, and tiles without any
    valid cell drop out."""
    w = Window.partitionBy(*TILE)
    known = tiles.withColumns({"_lo": F.min(value).over(w), "_hi": F.max(value).over(w), "_mean": F.avg(value).over(w)}).where(F.col("_lo").isNotNull())
    flat = F.col("_hi") <= F.col("_lo")
    x = F.try_divide(F.coalesce(F.col(value), F.col("_mean")) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (levels - 1)
    q = F.when(flat, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(x)))).cast("int")
    return known.select(*TILE, "row", "col", q.alias("q"), flat.alias("flat"))


def _counts(q: DataFrame, angles: list[int]) -> DataFrame:
    """(tile, i, j, flat, n<angle>...): how often grey levels meet at each angle, in both orders. A tile without any pair
    still has a row, of NULL levels."""
    q = q.withColumns({"_sum": F.col("row") + F.col("col"), "_diff": F.col("row") - F.col("col")})
    for a in angles:
        line, order = LINES[a]
        w = Window.partitionBy(*TILE, line).orderBy(order)
        q = q.withColumn(f"_j{a}", F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag("q").over(w)))
    pair = lambda a, i, j: F.when(F.col(f"_j{a}").isNotNull(), F.struct(F.lit(a).alias("angle"), i.alias("i"), j.alias("j")))
    both = [pair(a, *x) for a in angles for x in ((F.col("q"), F.col(f"_j{a}")), (F.col(f"_j{a}"), F.col("q")))]
    met = q.withColumn("p", F.explode_outer(F.array_compact(F.array(*both))))
    return met.groupBy(*TILE, F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.first("flat").alias("flat"), *[F.count_if(F.col("p.angle") == a).alias(f"n{a}") for a in angles])


def _shares(counts: DataFrame, angles: list[int]) -> tuple[DataFrame, list[Column], Column]:
    """Counts with their totals by tile; each angle's probability, NULL if the tile has no such pair; their mean."""
    w = Window.partitionBy(*TILE)
    out = counts.withColumns({f"t{a}": F.sum(f"n{a}").over(w) for a in angles})
    shares = [F.try_divide(F.col(f"n{a}"), F.col(f"t{a}")) for a in angles]
    total, known = F.lit(0.0), F.lit(0)
    for p in shares:
        total, known = total + F.coalesce(p, F.lit(0.0)), known + p.isNotNull().cast("int")
    return out, shares, F.try_divide(total, known)


def _entropy(p: Column) -> Column:
    return -F.sum(p * F.log2(p + 1e-12))


def _or_flat(value: Column, flat: float) -> Column:
    return F.when(F.max("flat"), flat).otherwise(F.coalesce(value, F.lit(flat)))


def tiles_of(pixels: DataFrame, value: str, block: int) -> DataFrame:
    cell = [F.floor(F.col(c) / block).cast("int").alias(t) for c, t in (("row", "tile_r"), ("col", "tile_c"))]
    return pixels.select(*cell, "row", "col", F.col(value))


def padded_tiles(pixels: DataFrame, value: str, block: int, height: int, width: int, window: int = 7) -> DataFrame:
    """Tiles with `window // 2` more cells on each side; cells outside the raster are there as invalid ones."""
    p = window // 2
    w = width + 2 * p
    cells = pixels.sparkSession.range((height + 2 * p) * w).select((F.floor(F.col("id") / w) - p).cast("int").alias("row"), (F.col("id") % w - p).cast("int").alias("col"))
    known = pixels.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(value))

    def tiles(at, n):
        last = (n - 1) // block
        first = F.greatest(F.lit(0), F.floor((at - p) / block).cast("int"))
        upto = F.least(F.lit(last), F.floor((at + p) / block).cast("int"))
        return F.filter(F.sequence(F.least(first, F.lit(last)), F.greatest(upto, F.lit(0))), lambda t: (at >= t * block - p) & (at < F.least((t + 1) * block, F.lit(n)) + p))

    spread = cells.join(known, ["row", "col"], "left").withColumn("tile_r", F.explode(tiles(F.col("row"), height)))
    return spread.withColumn("tile_c", F.explode(tiles(F.col("col"), width))).select("tile_r", "tile_c", "row", "col", value)


def glcm_tile(tiles: DataFrame, value: str, levels: int = 16) -> DataFrame:
    """(tile_r, tile_c, contrast, homogeneity, entropy) from pairs along rows; homogeneity weighs by 1 + |i - j|. Tiles
    that are flat or have no pair get the values of a flat surface."""
    counts, (p,), _ = _shares(_counts(_levels(tiles, value, levels), [0]), [0])
    d = F.col("i") - F.col("j")
    return counts.groupBy(*TILE).agg(
        _or_flat(F.sum(p * d * d), 0.0).alias("contrast"),
        _or_flat(F.sum(p / (1 + F.abs(d))), 1.0).alias("homogeneity"),
        _or_flat(_entropy(F.when(d.isNotNull(), p)), 0.0).alias("entropy"),
    )


def glcm_directional(tiles: DataFrame, value: str, levels: int = 32, angles: tuple[int, ...] = (0, 45, 90, 135)) -> DataFrame:
    """(tile_r, tile_c, contrast, homogeneity, correlation, entropy), averaged over the angles; homogeneity weighs by
    1 + (i - j)**2, and the entropy is that of the averaged matrix.

    Contrast and homogeneity are linear in the probabilities, so their averages are those of the mean matrix; the
    correlation is taken angle by angle.
    """
    counts, shares, mean = _shares(_counts(_levels(tiles, value, levels), list(angles)), list(angles))
    i, j, d = F.col("i").cast("double"), F.col("j").cast("double"), F.col("i") - F.col("j")
    corr = []
    for p in shares:
        mi, mj = F.sum(p * i), F.sum(p * j)
        spread = F.sqrt(F.greatest(F.sum(p * i * i) - mi * mi, F.lit(0.0)) * F.greatest(F.sum(p * j * j) - mj * mj, F.lit(0.0)))
        corr.append(F.when(spread < 1e-15, 1.0).otherwise(F.try_divide(F.sum(p * i * j) - mi * mj, spread)))
    known = F.filter(F.array(*corr), lambda c: c.isNotNull())
    average = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), F.size(known))
    return counts.groupBy(*TILE).agg(
        _or_flat(F.sum(mean * d * d), 0.0).alias("contrast"),
        _or_flat(F.sum(mean / (1 + d * d)), 1.0).alias("homogeneity"),
        _or_flat(average, 0.0).alias("correlation"),
        _or_flat(_entropy(F.when(d.isNotNull(), mean)), 0.0).alias("entropy"),
    )


def spread_to_pixels(pixels: DataFrame, texture: DataFrame, block: int, prefix: str = "glcm_") -> DataFrame:
    """Each pixel with its tile's texture."""
    named = texture.select("tile_r", "tile_c", *[F.col(c).alias(prefix + c) for c in texture.columns[2:]])
    placed = pixels.withColumns({"tile_r": F.floor(F.col("row") / block).cast("int"), "tile_c": F.floor(F.col("col") / block).cast("int")})
    return placed.join(named, ["tile_r", "tile_c"], "left").drop("tile_r", "tile_c")


def texture_summary(texture: DataFrame) -> DataFrame:
    """(property, mean, std, min, max) over tiles; population deviation."""
    names = texture.columns[2:]
    long = texture.select(F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).alias("x")) for n in names])).alias("e")).select("e.*")
    return long.groupBy("property").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
