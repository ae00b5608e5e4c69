"""Sinks: tables by tile, masks as GeoTIFF, KML and CSV files."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.functions import geo, images
from acreframe.sources import rasters
from acreframe.sources.files import put_file


def exists(spark: SparkSession, path: str) -> bool:
    """Does a path of any file system hold something? A download or export is skipped if so."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_tiles(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each tile, so that readers of some tiles prune the rest; a tile's rows are written by one task."""
    rows.repartition("tile").write.mode(mode).partitionBy("tile").parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Write unless something is there: working labels start from the master ones only once."""
    rows.write.mode("ignore").parquet(path)


def write_masks(mask: DataFrame, folder: str, height: int, width: int, transform: tuple[float, ...], on: int = 1, epsg: int = SETTINGS.epsg) -> DataFrame:
    """(tile, path, pixels) of an LZW GeoTIFF of unsigned bytes for each tile of a mask (tile, r, c, v), 0 where there is no pixel.

    Files go to a folder of their own, of a file system that all executors share, never beside the inputs, and are there when all
    are (``sources/rasters``); ``on`` is the value of set pixels, 1 or 255.
    """
    return rasters.save(mask, ["v"], folder, height, width, transform, dtype="uint8", compression="lzw", epsg=epsg, prefix="", suffix="_mask", on=on, count="set")


def write_rasters(pixels: DataFrame, bands: Sequence[str], folder: str, height: int, width: int, transform: tuple[float, ...], nodata: float = -9999.0, epsg: int = SETTINGS.epsg, strip_rows: int = 256) -> DataFrame:
    """(tile, path, pixels) of a Deflate GeoTIFF of doubles for each tile of pixels (tile, r, c, bands), named by tile and bands."""
    return rasters.save(pixels, bands, folder, height, width, transform, predictor=3, nodata=nodata, epsg=epsg, named=True, strip_rows=strip_rows)


def write_pictures(pixels: DataFrame, folder: str, height: int, width: int) -> DataFrame:
    """(tile, path) of a PNG file for each tile of pixels (tile, r, c, red, green, blue), black where there is no pixel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, 3), "uint8")
        image[pdf.r.to_numpy(), pdf.c.to_numpy()] = pdf[["red", "green", "blue"]].to_numpy()
        path = put_file(folder, f"tile_{pdf.tile.iloc[0]}.png", images.encode_png(image))
        return pd.DataFrame({"tile": [pdf.tile.iloc[0]], "path": [path]})

    kind = pixels.schema["tile"].dataType.simpleString()
    return pixels.select("tile", "r", "c", "red", "green", "blue").groupBy("tile").applyInPandas(run, f"tile {kind}, path string")


def write_kml(marks: DataFrame, path: str) -> None:
    """A KML text file for each tile of placemarks (tile, kml), below a folder for the tile."""
    whole = marks.groupBy("tile").agg(geo.document(F.array_join(F.sort_array(F.collect_list("kml")), "")).alias("value"))
    whole.write.mode("overwrite").partitionBy("tile").text(path)


def overlay(pixels: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Pixels with ``marked``: is a point (tile, r, c) at most ``radius`` cells away?

    Points are spread over the cells of their circle and joined by the pixel's key.
    """
    inside = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in inside]))
    cells = points.select("tile", "r", "c", offsets.alias("o")).select("tile", (F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c")).distinct().withColumn("_on", F.lit(True))
    return pixels.join(cells, ["tile", "r", "c"], "left").withColumn("marked", F.coalesce("_on", F.lit(False))).drop("_on")
