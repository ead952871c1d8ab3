"""Connected components of a class map and the minimum-mapping-unit filter.

Tiles are labelled on their own (an Arrow-fed NumPy kernel of bounded size), then only the pairs of labels that meet
across tile borders are merged, by labels that spread and jump; each round is a checkpoint. With a `layer` column (which
has to be filled) components lie within a layer: labels carry it, and a label is a cell's number in its own layer.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import layer_of

BLOCK = 256


def _checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut by checkpoint() in the session's shared folder; local mode may make one of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orelens-"))
    return df.checkpoint()


def _forward(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)


def _labeller(width: int, steps: list[tuple[int, int]]):
    def label(tile: pd.DataFrame) -> pd.DataFrame:
        r, c = tile["row"].to_numpy(), tile["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        h, w = r.max() - r0 + 1, c.max() - c0 + 1
        cls, at = np.full((h, w), np.iinfo(np.int64).min), np.full((h, w), -1)
        cls[r - r0, c - c0], at[r - r0, c - c0] = tile["cls"].to_numpy(), np.arange(len(r))
        a, b = [], []
        for dr, dc in steps:
            x = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
            y = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
            same = (cls[x] == cls[y]) & (at[x] >= 0) & (at[y] >= 0)
            a.append(at[x][same])
            b.append(at[y][same])
        a, b = np.concatenate(a), np.concatenate(b)
        up = np.arange(len(r))
        while True:  # hook the larger root to the smaller, then jump
            ra, rb = up[a], up[b]
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            if (lo == hi).all():
                break
            np.minimum.at(up, hi, lo)
            while (up != up[up]).any():
                up = up[up]
        key = r.astype(np.int64) * width + c
        least = np.full(len(r), np.iinfo(np.int64).max)
        np.minimum.at(least, up, key)
        layer = {"layer": tile["layer"]} if "layer" in tile else {}
        return pd.DataFrame(layer | {"row": r, "col": c, "cls": tile["cls"], "label": least[up]})

    return label


def merge_labels(links: DataFrame) -> DataFrame:
    """(label, root) of every label in links (a, b): the smallest that can be reached."""
    both = _checkpointed(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    roots = _checkpointed(both.groupBy(F.col("a").alias("label")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("label", "b"), "b").groupBy(F.col("a").alias("label")).agg(F.min("root").alias("near"))
        spread = roots.join(near, "label").select("label", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jumps = roots.select(F.col("label").alias("root"), F.col("root").alias("jump"))
        after = _checkpointed(spread.join(jumps, "root", "left").select("label", F.least("root", "jump").alias("root"), "was"))
        roots = after.select("label", "root")
        if not after.where("root <> was").limit(1).count():
            return roots


def _labelled(classes: DataFrame, cls: str, width: int, connectivity: int, block: int) -> DataFrame:
    """(layer, row, col, cls, label) of valid cells; a label is (layer, number) where there are layers."""
    steps, layer = _forward(connectivity), layer_of(classes)
    valid = classes.where(F.col(cls).isNotNull()).select(*layer, F.col("row").cast("long"), F.col("col").cast("long"), F.col(cls).cast("long").alias("cls"))
    tile = [F.floor(F.col(c) / block).alias(t) for c, t in (("row", "tile_r"), ("col", "tile_c"))]
    kinds = "".join(f"`{c}` {valid.schema[c].dataType.simpleString()}, " for c in layer)
    local = valid.groupBy(*layer, *tile).applyInPandas(_labeller(width, steps), kinds + "row long, col long, cls long, label long")
    local = _checkpointed(local.withColumn("label", F.struct("layer", "label")) if layer else local)
    edge = local.where((F.col("row") % block).isin(0, block - 1) | (F.col("col") % block).isin(0, block - 1))
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in steps])
    there = edge.withColumn("s", F.explode(moves)).select(*layer, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "cls", F.col("label").alias("a"))
    links = there.join(edge.withColumnRenamed("label", "b"), [*layer, "row", "col", "cls"]).where("a <> b").select("a", "b").distinct()
    roots = merge_labels(links)
    return local.join(roots, "label", "left").select(*layer, "row", "col", "cls", F.coalesce("root", "label").alias("label"))


def label_components(classes: DataFrame, cls: str, width: int, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """(layer, row, col, cls, label) of valid cells; a component's label is its first cell's number in row-major order."""
    out = _labelled(classes, cls, width, connectivity, block)
    return out.withColumn("label", F.col("label.label")) if layer_of(classes) else out


def sieve_threshold(mmu_ha: float, res_m: float) -> int:
    return max(1, math.ceil(mmu_ha / (res_m * res_m / 10000.0)))


def sieve(classes: DataFrame, cls: str, width: int, threshold: int, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """Components smaller than `threshold` take the class of their largest neighbour (the smallest label among equals); if
    that is small too, of the neighbour it would take, and so on. Two small ones that point at each other stay as they
    are. Invalid cells are no component and stay invalid."""
    layer = layer_of(classes)
    labelled = _checkpointed(_labelled(classes, cls, width, connectivity, block))
    number = F.col("label.label") if layer else F.col("label")
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"), F.first("cls").alias("cls"))
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in _forward(connectivity)])
    there = labelled.withColumn("s", F.explode(moves)).select(*layer, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("label").alias("a"))
    touch = there.join(labelled.select(*layer, "row", "col", F.col("label").alias("b")), [*layer, "row", "col"]).where("a <> b").select("a", "b").distinct()
    touch = touch.union(touch.select(F.col("b"), F.col("a"))).distinct()
    big = sizes.select(F.col("label").alias("b"), F.struct(F.col("n"), (-number).alias("l"), F.col("label").alias("of")).alias("rank"))
    largest = touch.join(big, "b").groupBy(F.col("a").alias("label")).agg(F.max("rank")["of"].alias("next"))
    hops = sizes.join(largest, "label", "left").select("label", "cls", F.when(F.col("n") < threshold, F.coalesce("next", "label")).otherwise(F.col("label")).alias("next"), (F.col("n") >= threshold).alias("kept"))
    hops = _checkpointed(hops)
    to = hops.select("label", "next")
    while True:  # each round doubles the reach; two that point at each other come to rest after the first
        step = to.select(F.col("label").alias("next"), F.col("next").alias("over"))
        after = _checkpointed(to.join(step, "next").select("label", F.col("over").alias("next"), (F.col("over") != F.col("next")).alias("moved")))
        to = after.select("label", "next")
        if not after.where("moved").limit(1).count():
            break
    end = hops.select(F.col("label").alias("next"), F.col("cls").alias("new"), F.col("kept").alias("sound"))
    taken = to.join(end, "next").where("sound").select("label", "new")
    out = labelled.join(taken, "label", "left").select(*layer, F.col("row").cast("int"), F.col("col").cast("int"), F.coalesce("new", "cls").alias("_new"))
    kind = classes.schema[cls].dataType
    return classes.join(out, [*layer, "row", "col"], "left").select(*[c for c in classes.columns], "_new").withColumn(cls, F.col("_new").cast(kind)).drop("_new")
