"""Cloud-masked seasonal composites of scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.functions import indices as X


def clear(qa):
    """Neither the cloud bit nor the cirrus bit is set."""
    return (qa.bitwiseAND(1 << SETTINGS.opaque_bit) == 0) & (qa.bitwiseAND(1 << SETTINGS.cirrus_bit) == 0)


def mask_clouds(scenes: DataFrame, bands: Sequence[str] = SETTINGS.bands) -> DataFrame:
    """Bands of cloudy pixels become null; rows stay."""
    return scenes.withColumns({b: F.when(clear(F.col("qa")), F.col(b)) for b in bands})


def select_scenes(scenes: DataFrame, start: str, end: str, cloud_below: float, box: tuple[int, int] | None = None) -> DataFrame:
    """Scenes of a half-open time range with little cloud, and of a range of tiles."""
    found = scenes.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")) & (F.col("cloud_pct") < cloud_below))
    return found if box is None else found.where(F.col("tile").between(*box))


def seasonal_median(scenes: DataFrame, bands: Sequence[str] = SETTINGS.bands, keys: Sequence[str] = ("tile", "r", "c", "season")) -> DataFrame:
    """Median of each band for each pixel and season; masked values do not count."""
    return scenes.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def stacked(scenes: DataFrame, bands: Sequence[str] = SETTINGS.bands, seasons: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """A row for each pixel with ``<band>_s<season>`` medians and indices, all doubles: one shuffle on the pixel's key."""
    grouped = scenes.groupBy("tile", "r", "c").agg(*[F.median(F.when(F.col("season") == s, F.col(b))).cast("double").alias(f"{b}_s{s}") for s in seasons for b in bands])
    named = lambda s: {b: F.col(f"{b}_s{s}") for b in bands}
    extra = {}
    for s in seasons:
        b = named(s)
        extra |= {f"NDVI_s{s}": X.ndvi(b["B8"], b["B4"]), f"EVI_s{s}": X.evi(b["B8"], b["B4"], b["B2"]), f"EVI2_s{s}": X.evi2(b["B8"], b["B4"]), f"NBR_s{s}": X.nbr(b["B8"], b["B12"]), f"NDMI_s{s}": X.ndmi(b["B8"], b["B11"])}
    return grouped.withColumns(extra)


def intersecting(scenes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Scenes whose footprint (x0, y0, x1, y1) meets a box, borders included."""
    return scenes.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
