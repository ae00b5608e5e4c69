"""A data source of Spark that writes a GeoTIFF file for each tile, and publishes the files of a write when all its tasks are done.

Each attempt of a task writes to a folder of its own below ``.<token>``, where no reader of the folder looks. ``commit`` moves the
files of the attempts that counted to their names and writes a manifest of them last; ``abort`` deletes the folder. A task that
fails and runs again leaves one file for each tile, a write that fails leaves none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from acreframe.sources import geotiff
from acreframe.sources.scenes import file_system

FORMAT = "acreframe_rasters"
MANIFEST = "tiles"


@dataclass
class Written(WriterCommitMessage):
    """(path below the write's folder, name, tile, cells) of each file of a task's attempt."""

    files: list[tuple[str, str, str, int]]


class RasterWriter(DataSourceArrowWriter):
    """``options`` has the folder and, as JSON, what all files share."""

    def __init__(self, path: str, form: dict):
        self.path, self.form, self.token = path, form, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A file for each run of rows of one tile; a tile whose rows stand apart is an error."""
        system, root = file_system(self.path)
        attempt = f".{self.token}/{uuid.uuid4().hex}"
        system.create_dir(f"{root}/{attempt}", recursive=True)
        form, files, seen = self.form, [], set()
        bands, kind = form["bands"], np.dtype(form["dtype"])
        image, of, cells = None, None, 0

        def put() -> None:
            if image is None:
                return
            if of in seen:
                raise ValueError(f"rows of tile {of} stand apart: sort them by tile")
            seen.add(of)
            name = f"{form['prefix']}{of}{form['suffix']}.tif"
            data = geotiff.encode(image, tuple(form["transform"]), form["compression"], form["predictor"], form["nodata"], form["epsg"], bands if form["named"] else None, form["strip_rows"])
            with system.open_output_stream(f"{root}/{attempt}/{name}") as f:
                f.write(data)
            files.append((f"{attempt}/{name}", name, str(of), cells))

        for batch in iterator:
            tiles = np.array(batch["tile"].to_pylist(), object)
            r, c = (batch[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("r", "c"))
            values = [batch[b].to_numpy(zero_copy_only=False).astype(float) for b in bands]
            cuts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]]))
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if tiles[begin] != of or image is None:
                    put()
                    of, cells = tiles[begin], 0
                    image = np.full((len(bands), form["height"], form["width"]), form["nodata"] or 0, kind)
                for k, v in enumerate(values):
                    image[k, r[begin:end], c[begin:end]] = np.nan_to_num(v[begin:end] * form["on"], nan=form["nodata"] or 0)
                cells += end - begin if form["count"] == "rows" else int((values[0][begin:end] != 0).sum())
        put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name, _, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a tile was written by more than one task")
        for at, name, _, _ in files:
            if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/{name}")  # some file systems do not move onto a file
            system.move(f"{root}/{at}", f"{root}/{name}")
        with system.open_output_stream(f"{root}/{MANIFEST}-{self.token}.json") as f:
            f.write("".join(json.dumps({"tile": tile, "path": f"{self.path.rstrip('/')}/{name}", "pixels": cells}) + "\n" for _, name, tile, cells in files).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the write stays that was not published."""
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/.{self.token}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/.{self.token}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "tile string"

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"], json.loads(self.options["form"]))


def save(pixels: DataFrame, bands: Sequence[str], folder: str, height: int, width: int, transform: tuple[float, ...], **form) -> DataFrame:
    """Write a file for each tile of pixels (tile, r, c, bands); (tile, path, pixels) of the files of this and earlier writes."""
    spark = pixels.sparkSession
    spark.dataSource.register(RasterSource)
    whole = {"bands": list(bands), "height": height, "width": width, "transform": list(transform), "dtype": "float64", "compression": "deflate", "predictor": 1, "nodata": None, "epsg": None, "named": False, "strip_rows": 256, "prefix": "tile_", "suffix": "", "on": 1, "count": "rows"} | form
    rows = pixels.select("tile", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(b).cast("double").alias(b) for b in bands])
    rows.repartition("tile").sortWithinPartitions("tile").write.format(FORMAT).mode("append").option("path", folder).option("form", json.dumps(whole)).save()
    kind = pixels.schema["tile"].dataType.simpleString()
    return spark.read.schema("tile string, path string, pixels long").option("pathGlobFilter", f"{MANIFEST}-*.json").json(folder).select(F.col("tile").cast(kind).alias("tile"), "path", "pixels")
