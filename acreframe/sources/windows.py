"""Raster files read block by block: whole ones dealt out over tasks, and of windows only the blocks that hold cells asked for.

A file's directory tells its geometry; it is read by range, so listing files of any size is cheap. A whole read makes a row of each
block, which any task can read, so one large file is shared by many tasks.

Cells meet their file's geometry by an equi-join on the tile, which tells the block that each cell lies in; cells are grouped by
block, a group being a block's cells at most, and a task reads the bytes of its blocks by range. So what is read grows
with the windows, not with the files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.operators import patches
from acreframe.sources import geotiff
from acreframe.sources.files import tile_of

PAGE = 4096  # bytes that a directory is read in


class Ranges:
    """The bytes of a file that a slice asks for, read when it does; small ones by pages that are kept."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        self.file, self.pages, self.read = system.open_input_file(inside), {}, 0
        self.length = self.file.size()

    def _at(self, start: int, stop: int) -> bytes:
        stop = min(stop, self.length)
        self.read += max(0, stop - start)
        return self.file.read_at(max(0, stop - start), start) if stop > start else b""

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, part.stop
        if stop - start >= PAGE:
            return self._at(start, stop)
        first, last = start // PAGE, max(start, stop - 1) // PAGE
        for k in range(first, last + 1):
            if k not in self.pages:
                self.pages[k] = self._at(k * PAGE, (k + 1) * PAGE)
        return b"".join(self.pages[k] for k in range(first, last + 1))[start - first * PAGE : stop - first * PAGE]

    def close(self) -> None:
        self.file.close()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, tile) of the raster files of a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path", tile_of(F.col("path")).alias("tile"))


def _directories(files: DataFrame, told, schema: str) -> DataFrame:
    """(tile, path, told(blocks, metadata)) of files, from their directories alone."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, tile in zip(pdf.path, pdf.tile, strict=True):
                data = Ranges(path)
                order, tags = geotiff.tags_of(data)
                data.close()
                out.append((tile, path, *told(geotiff.Blocks.of(order, tags), geotiff.metadata_of(tags))))
            yield pd.DataFrame(out, columns=names, dtype=object)

    whole = f"tile string, path string, {schema}"
    names = [c.strip().split(" ")[0] for c in whole.split(",")]
    return files.mapInPandas(run, whole)


def geometry(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, path, height, width, block_height, block_width) of the raster files of a folder."""
    return _directories(_files(spark, folder), lambda b, m: (b.height, b.width, b.block_height, b.block_width), "height long, width long, block_height long, block_width long")


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, width, height, bands, dtype, nodata, epsg, transform, left, bottom, right, top, descriptions) of the files of a folder."""
    told = lambda b, m: (m.width, m.height, m.bands, m.dtype, m.nodata, m.epsg, list(m.transform), *m.bounds, m.descriptions)
    schema = "width long, height long, bands long, dtype string, nodata double, epsg long, transform array<double>, left double, bottom double, right double, top double, descriptions array<string>"
    return _directories(_files(spark, folder), told, schema).drop("path")


def read_pixels(spark: SparkSession, folder: str, bands: list[int] | None = None) -> DataFrame:
    """(tile, row, col, x, y, features) of every pixel of the files of a folder; ``bands`` picks some, from 0; missing values are null.

    A row for each block is dealt out over the shuffle partitions, and the task that gets it reads its bytes.
    """
    index = geometry(spark, folder)
    last = F.ceil(F.col("height") / F.col("block_height")) * F.ceil(F.col("width") / F.col("block_width")) - 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = index.select("tile", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition(parts, "path", "block")

    def run(batches):
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=True):
                data = Ranges(path)
                try:
                    order, tags = geotiff.tags_of(data)
                    whole, told = geotiff.Blocks.of(order, tags), geotiff.metadata_of(tags)
                    chosen = list(range(whole.depth)) if bands is None else bands
                    a, _, c, _, e, f = told.transform
                    for tile, cell in zip(own.tile, own.block, strict=True):
                        image = whole.read(data, int(cell), chosen).astype(float)
                        if told.nodata is not None:
                            image[image == told.nodata] = np.nan
                        r0, c0 = whole.origin(int(cell))
                        rows, cols = (x.ravel() for x in np.mgrid[r0 : r0 + image.shape[1], c0 : c0 + image.shape[2]])
                        values = image.reshape(len(image), -1).T
                        for at in range(0, len(rows), 16_384):
                            r, k = rows[at : at + 16_384], cols[at : at + 16_384]
                            yield pd.DataFrame({"tile": tile, "row": r.astype("int32"), "col": k.astype("int32"), "x": c + (k + 0.5) * a, "y": f + (r + 0.5) * e, "features": list(values[at : at + 16_384])})
                finally:
                    data.close()

    return blocks.mapInPandas(run, "tile string, row int, col int, x double, y double, features array<double>")


def read_cells(cells: DataFrame, index: DataFrame, bands: Sequence[int]) -> DataFrame:
    """(tile, r, c, values, read) of the cells (tile, r, c) that a file of ``geometry`` holds, each once; missing values are null.

    ``read`` is the number of bytes that were read for the cell's block, counted at one cell of each block.
    """
    inside = cells.select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().join(index, "tile").where("r >= 0 and c >= 0 and r < height and c < width")
    across = F.ceil(F.col("width") / F.col("block_width"))
    block = (F.floor(F.col("r") / F.col("block_height")) * across + F.floor(F.col("c") / F.col("block_width"))).cast("long")
    wanted = inside.groupBy("path", "tile", block.alias("block")).agg(F.collect_list("r").alias("rs"), F.collect_list("c").alias("cs"))  # a block's cells at most

    def run(batches):
        for pdf in batches:
            for path, own in pdf.groupby("path", sort=True):
                data = Ranges(path)
                try:
                    order, tags = geotiff.tags_of(data)
                    blocks, missing = geotiff.Blocks.of(order, tags), geotiff.metadata_of(tags).nodata
                    for tile, cell, rs, cs in zip(own.tile, own.block, own.rs, own.cs, strict=True):
                        before = data.read
                        image = blocks.read(data, int(cell), bands).astype(float)
                        r, c = np.array(rs), np.array(cs)
                        r0, c0 = blocks.origin(int(cell))
                        values = image[:, r - r0, c - c0].T
                        told = [[None if np.isnan(v) or v == missing else float(v) for v in row] for row in values]
                        yield pd.DataFrame({"tile": tile, "r": r, "c": c, "values": told, "read": [data.read - before] + [0] * (len(r) - 1)})
                finally:
                    data.close()

    return wanted.mapInPandas(run, "tile string, r long, c long, values array<double>, read long")


def read_windows(points: DataFrame, index: DataFrame, bands: Sequence[int], side: int = 3) -> DataFrame:
    """(key, features) of the window around each point (key, tile, r, c), as ``patches.window_features`` gives them, from files.

    A window is moved to stay inside its file; points of files that are not there, or outside, are left out.
    """
    placed = points.select("key", "tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).join(index.select("tile", "height", "width"), "tile").where("r >= 0 and c >= 0 and r < height and c < width")
    k = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    first = placed.withColumns({"_r0": patches.clamped_origin(F.col("r"), F.col("height"), side), "_c0": patches.clamped_origin(F.col("c"), F.col("width"), side)})
    spread = first.select("key", "tile", "_r0", "_c0", k.alias("_k")).select("key", "tile", (F.col("_r0") + F.floor(F.col("_k") / side)).alias("r"), (F.col("_c0") + F.col("_k") % side).alias("c"), "_k")
    got = read_cells(spread, index, bands).select("tile", "r", "c", F.transform("values", lambda v: F.coalesce(v, F.lit(0.0))).alias("v"))
    joined = spread.join(got, ["tile", "r", "c"], "left")
    value = F.struct(F.col("_k").alias("k"), F.coalesce("v", F.array_repeat(F.lit(0.0), len(bands))).alias("v"))
    return joined.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["v"])).alias("features"))
