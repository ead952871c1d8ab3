"""The grid side of pixel tables: tiles, halos, padded borders, overviews, conversions.

A table with a `layer` column holds several rasters of one size; whatever looks at a cell's neighbours, or sums up a
raster, does so layer by layer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK, DRONE_BLOCK, LARGE_PIXELS, LARGE_BLOCK = 512, 256, 100_000_000, 512


def along_row(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "row").orderBy("col")


def along_col(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "col").orderBy("row")


def layer_of(pixels: DataFrame) -> tuple[str, ...]:
    """The key that tells the rasters of a table apart, if it has one."""
    return ("layer",) * ("layer" in pixels.columns)


def by_layer(pixels: DataFrame, rows: DataFrame) -> DataFrame:
    """pixels with the columns of their layer's row, or of the one row there is."""
    if not layer_of(rows):
        return pixels.join(F.broadcast(rows), how="inner")  # an aggregate's one row
    return pixels.join(rows.withColumnRenamed("layer", "_layer"), F.col("layer").eqNullSafe(F.col("_layer"))).drop("_layer")


def count_windows(height: int, width: int, block: int) -> int:
    return math.ceil(height / block) * math.ceil(width / block)


def block_size(height: int, width: int, block: int = BLOCK) -> int:
    """The block asked for; at most LARGE_BLOCK beyond 100 million pixels."""
    return min(block, LARGE_BLOCK) if height * width > LARGE_PIXELS else block


def windows(spark, height: int, width: int, block: int = BLOCK) -> DataFrame:
    """(tile, row_off, col_off, h, w) in row-major order, clipped at the edges."""
    block = block_size(height, width, block)
    across = math.ceil(width / block)
    row, col = F.floor(F.col("id") / across) * block, (F.col("id") % across) * block
    return spark.range(count_windows(height, width, block)).select(
        F.col("id").alias("tile"),
        row.alias("row_off"),
        col.alias("col_off"),
        F.least(F.lit(block), F.lit(height) - row).alias("h"),
        F.least(F.lit(block), F.lit(width) - col).alias("w"),
    )


def tile_id(block: int) -> tuple[Column, Column]:
    return F.floor(F.col("row") / block).cast("int").alias("tile_r"), F.floor(F.col("col") / block).cast("int").alias("tile_c")


def from_sentinel(value: Column, nodata: float | None) -> Column:
    """Nodata, NaN and infinities become NULL."""
    x = value.cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(~(bad if nodata is None else bad | (x == nodata)), x)


def complete(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Every cell of the grid, with NULLs where the table has no row: what focal operators assume."""
    if layer_of(pixels):
        lines = pixels.select(F.col("layer").alias("_layer")).distinct().withColumn("_row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
        every = lines.withColumn("_col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        same = F.col("_layer").eqNullSafe(F.col("layer")) & (F.col("_row") == F.col("row")) & (F.col("_col") == F.col("col"))
        place = {"layer": "_layer", "row": "_row", "col": "_col"}
        return every.join(pixels, same, "left").select(*[F.col(place[c]).alias(c) if c in place else c for c in pixels.columns])
    cells = pixels.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return cells.join(pixels.withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}), ["row", "col"], "left")


def _places(at: Column, n: int, p: int, mode: str) -> Column:
    """Where a row (or column) number also stands once p lines are added at either side.

    nearest repeats the edge; mirror leaves the edge out (d c b | a b c d); symmetric repeats it (c b a | a b c d).
    """
    if mode == "nearest":
        before = F.when(at == 0, F.sequence(F.lit(-p), F.lit(-1)))
        after = F.when(at == n - 1, F.sequence(F.lit(n), F.lit(n + p - 1)))
    elif mode == "mirror":
        before = F.when((at >= 1) & (at <= p), F.array(-at))
        after = F.when((at >= n - 1 - p) & (at <= n - 2), F.array(2 * (n - 1) - at))
    elif mode == "symmetric":
        before = F.when(at < p, F.array(-1 - at))
        after = F.when(at >= n - p, F.array(2 * n - 1 - at))
    else:
        raise ValueError(f"unknown border mode {mode}")
    none = F.array().cast("array<int>")
    return F.concat(F.array(at), F.coalesce(before.cast("array<int>"), none), F.coalesce(after.cast("array<int>"), none))


def pad(pixels: DataFrame, height: int, width: int, p: int, mode: str) -> DataFrame:
    """The table with p more lines on every side; only cells near the border are copied."""
    if p and mode != "nearest" and min(height, width) <= p - (mode == "symmetric"):
        raise ValueError(f"a {height} x {width} grid can't be reflected by {p}")
    row, col = F.col("row").cast("int"), F.col("col").cast("int")
    placed = pixels.withColumn("row", F.explode(_places(row, height, p, mode)))
    return placed.withColumn("col", F.explode(_places(col, width, p, mode)))


def inside(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def overview(pixels: DataFrame, height: int, width: int, bands: list[str], most: int = 512) -> DataFrame:
    """A thumbnail whose longer side has `most` pixels, by averages; smaller rasters are enlarged by repetition."""
    scale = most / max(height, width)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    if scale >= 1:
        cells = pixels.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("r"), (F.col("id") % w).cast("int").alias("c"))
        cells = cells.withColumns({"row": F.floor(F.col("r") * height / h).cast("int"), "col": F.floor(F.col("c") * width / w).cast("int")})
        own = pixels.select(*layer_of(pixels), F.col("row").cast("int"), F.col("col").cast("int"), *bands)
        return cells.join(own, ["row", "col"]).select(*layer_of(pixels), F.col("r").alias("row"), F.col("c").alias("col"), *bands)
    return pixels.groupBy(*layer_of(pixels), F.floor(F.col("row") * h / height).cast("int").alias("row"), F.floor(F.col("col") * w / width).cast("int").alias("col")).agg(*[F.avg(b).alias(b) for b in bands])


def pyramid(pixels: DataFrame, band: str, factors: tuple[int, ...] = (2, 4, 8, 16), classes: bool = False) -> DataFrame:
    """(factor, row, col, band) of reduced copies: averages, or for classes the nearest (first) pixel of each cell.

    One pass gives all levels: a pixel goes to one cell a level, and partial aggregates leave the scan.
    """
    levels = pixels.withColumn("factor", F.explode(F.array(*map(F.lit, factors))))
    cell = [F.floor(F.col(c) / F.col("factor")).cast("int").alias(c) for c in ("row", "col")]
    value = F.min_by(band, F.struct("row", "col")) if classes else F.avg(band)
    return levels.groupBy(*layer_of(pixels), "factor", *cell).agg(value.alias(band))
