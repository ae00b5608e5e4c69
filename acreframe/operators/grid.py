"""Tile grids, points in tiles, terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.operators import cells

# Bounding boxes (name, least lon, least lat, most lon, most lat) of the regions of interest (fixed values).
ISLANDS = (
    ("Testing", -24.400884, 16.644662, -24.392954, 16.652504),
    ("Boa_Vista", -22.97435929, 15.9576494, -22.65365956, 16.24065102),
    ("Brava", -24.75129827, 14.800214, -24.66054963, 14.90404257),
    ("Fogo", -24.50899065, 14.80591421, -24.27133253, 15.05926771),
    ("Maio", -23.23909088, 15.11019894, -23.07843073, 15.34264497),
    ("Sal", -23.0023089, 16.58008001, -22.86710809, 16.85967724),
    ("Santiago", -23.78654553, 14.89451334, -23.42397171, 15.34549301),
    ("Santo_Antao", -25.37237221, 16.89915026, -24.953279, 17.21441822),
    ("Sao_Nicolau", -24.4307613, 16.47636763, -24.00270139, 16.68656632),
    ("Sao_Vicente", -25.09002776, 16.77184887, -24.85245664, 16.92850691),
)


def islands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ISLANDS, "name string, x0 double, y0 double, x1 double, y1 double")


def box_of(ring: Column) -> Column:
    """Bounding box of a ring of structs (x, y)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def tile_grid(regions: DataFrame, cap: float = SETTINGS.tile_degrees) -> DataFrame:
    """Equal cells of at most ``cap`` degrees over each region's box; numbered down the columns."""
    n = {"cols": F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / F.lit(cap))), "rows": F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / F.lit(cap)))}
    sized = regions.withColumns(n).withColumns({"dx": (F.col("x1") - F.col("x0")) / F.col("cols"), "dy": (F.col("y1") - F.col("y0")) / F.col("rows")})
    cells = sized.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("cols") - 1).cast("int")))).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int"))))
    return cells.select(
        F.col("name").alias("island"),
        (F.col("i") * F.col("rows") + F.col("j")).cast("int").alias("tile_idx"),
        "i",
        "j",
        (F.col("x0") + F.col("i") * F.col("dx")).alias("x0"),
        (F.col("y0") + F.col("j") * F.col("dy")).alias("y0"),
        (F.col("x0") + (F.col("i") + 1) * F.col("dx")).alias("x1"),
        (F.col("y0") + (F.col("j") + 1) * F.col("dy")).alias("y1"),
    )


def tile_of_point(points: DataFrame, tiles: DataFrame, key: str, cell: float = SETTINGS.tile_degrees, most: int = SETTINGS.crowd) -> DataFrame:
    """The first tile, by name, whose box holds a point, borders included; null where none does.

    Tiles are listed under the cells of a grid that they touch, so each place meets few tiles through an equi-join; cells where
    places crowd are divided among tasks.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    listed = tiles.withColumn("_gx", span("x0", "x1")).withColumn("_gy", span("y0", "y1"))
    placed = points.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct().withColumns({"_gx": F.floor(F.col("_lon") / cell), "_gy": F.floor(F.col("_lat") / cell)})
    hit = cells.joined(placed, listed, ["_gx", "_gy"], F.col("_lon").between(F.col("x0"), F.col("x1")) & F.col("_lat").between(F.col("y0"), F.col("y1")), most)
    first = hit.groupBy("_lat", "_lon").agg(F.min("tile").alias("tile"))
    return points.drop("tile").join(first, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left").drop("_lat", "_lon")


def slope_aspect(pixels: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """Horn's slope and aspect, in degrees, of pixels that have all eight neighbours; null for others.

    Each pixel sends its value to the nine centres that it surrounds: one aggregation instead of eight joins.
    """
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    sent = pixels.select("tile", "r", "c", F.col(value).alias("z"), F.explode(offsets).alias("o")).select("tile", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "o.dr", "o.dc", "z")

    def at(dr: int, dc: int):
        return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("z")))

    g = sent.groupBy("tile", "r", "c").agg(*[at(dr, dc).alias(f"z{dr + 1}{dc + 1}") for dr in (-1, 0, 1) for dc in (-1, 0, 1)]).where(F.col("z11").isNotNull())
    z = lambda k: F.col(f"z{k}")
    dx = ((z("02") + 2 * z("12") + z("22")) - (z("00") + 2 * z("10") + z("20"))) / (8 * step)
    dy = ((z("20") + 2 * z("21") + z("22")) - (z("00") + 2 * z("01") + z("02"))) / (8 * step)
    turn = F.degrees(F.atan2(dy, -dx))
    aspect = F.when(turn > 90, 450 - turn).otherwise(90 - turn)
    return g.select("tile", "r", "c", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), aspect.alias("aspect"))
