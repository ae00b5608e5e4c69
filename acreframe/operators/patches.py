"""Windows and patches of rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamped_origin(centre: Column, size: Column, width: int) -> Column:
    """First row or column of a window around a cell, moved so that the window stays inside."""
    return F.greatest(F.least(centre - width // 2, size - width), F.lit(0))


def window_features(points: DataFrame, pixels: DataFrame, bands: Sequence[str], height: int, width: int, side: int = 3) -> DataFrame:
    """Values of the window around each point (key, tile, r, c), flattened by row, column and band; 0 where there is no pixel.

    Points are spread to the cells of their window, so pixels are found by an equi-join on (tile, r, c).
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    cells = points.select("key", "tile", clamped_origin(F.col("r"), F.lit(height), side).alias("_r0"), clamped_origin(F.col("c"), F.lit(width), side).alias("_c0"), k.alias("_k"))
    cells = cells.select("key", "tile", (F.col("_r0") + F.floor(F.col("_k") / side)).cast("bigint").alias("r"), (F.col("_c0") + F.col("_k") % side).cast("bigint").alias("c"), "_k")
    joined = cells.join(pixels.select("tile", "r", "c", *bands), ["tile", "r", "c"], "left")
    value = F.struct(F.col("_k").alias("k"), F.array(*[F.coalesce(F.col(b), F.lit(0.0)) for b in bands]).alias("v"))
    return joined.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["v"])).alias("features"))


def tumbling(pixels: DataFrame, side: int, height: int, width: int) -> DataFrame:
    """Pixels with the origin (pr, pc) of their patch; the ragged edge is left out."""
    placed = pixels.withColumns({"pr": (F.floor(F.col("r") / side) * side).cast("bigint"), "pc": (F.floor(F.col("c") / side) * side).cast("bigint")})
    return placed.where((F.col("pr") + side <= height) & (F.col("pc") + side <= width))


def patch_counts(tiles: DataFrame, side: int, stride: int) -> DataFrame:
    """Sliding and full patches of each tile (tile, height, width)."""
    steps = lambda size: F.floor((F.col(size) - side) / stride) + 1
    fits = (F.col("height") >= side) & (F.col("width") >= side)
    return tiles.select("tile", F.when(fits, steps("height") * steps("width")).otherwise(0).cast("bigint").alias("sliding"), (F.floor(F.col("height") / side) * F.floor(F.col("width") / side)).cast("bigint").alias("full"))


def augmented(cells: DataFrame, side: int, flip_h: Column, flip_v: Column, turns: Column) -> DataFrame:
    """Cells (r, c) of patches under flips, then quarter turns anticlockwise."""
    r0 = F.when(flip_v, side - 1 - F.col("r")).otherwise(F.col("r"))
    c0 = F.when(flip_h, side - 1 - F.col("c")).otherwise(F.col("c"))
    moved = cells.withColumns({"_r": r0, "_c": c0, "_t": turns})
    r, c, t = F.col("_r"), F.col("_c"), F.col("_t")
    new_r = F.when(t == 0, r).when(t == 1, side - 1 - c).when(t == 2, side - 1 - r).otherwise(c)
    new_c = F.when(t == 0, c).when(t == 1, r).when(t == 2, side - 1 - c).otherwise(side - 1 - r)
    return moved.withColumns({"r2": new_r, "c2": new_c}).drop("_r", "_c", "_t")
