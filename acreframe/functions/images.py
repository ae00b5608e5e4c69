"""Pictures by Spark's image source, brought to one size.

The source decodes PNG, JPEG, BMP and GIF files in the JVM. Resampling is bicubic (a = -0.5), by the area that a target
pixel covers where a picture shrinks, first along rows, then along columns, as common picture libraries do it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def coefficients(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) weights of source pixels."""
    scale = size / wanted
    reach = 2.0 * max(scale, 1.0)
    centre = (np.arange(wanted) + 0.5) * scale
    x = np.abs((np.arange(size)[None, :] + 0.5 - centre[:, None]) / max(scale, 1.0))
    a = -0.5
    w = np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, (((x - 5) * x + 8) * x - 4) * a, 0.0))
    inside = (np.arange(size)[None, :] >= np.floor(centre - reach + 0.5)[:, None]) & (np.arange(size)[None, :] < np.floor(centre + reach + 0.5)[:, None])
    w = np.where(inside, w, 0.0)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) of unsigned bytes."""
    rounded = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    across = rounded(np.einsum("hwc,xw->hxc", image.astype(float), coefficients(image.shape[1], width)))
    return rounded(np.einsum("hxc,yh->yxc", across, coefficients(image.shape[0], height))).astype("uint8")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue, in the whole-number form of common picture libraries."""
    r, g, b = (image[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype("uint8")[:, :, None]


def read_images(spark: SparkSession, folder: str, side: int = 512, mode: str = "RGB") -> DataFrame:
    """(name, height, width, channels, values) of the pictures of a folder: ``side`` by ``side``, RGB or L, rows of pixels
    of channels; files that are no pictures are left out. Name is the file's, without folder and extension."""
    found = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")

    def run(batches):
        for batch in batches:
            out = []
            for origin, h, w, n, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                image = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n)
                # The source gives blue, green, red (and opacity), or one channel.
                image = image[:, :, 2::-1] if n >= 3 else np.repeat(image, 3, axis=2)
                image = grey(image) if mode == "L" and n >= 3 else image[:, :, :1] if mode == "L" else image
                image = resize(image, side, side)
                out.append((origin.rsplit("/", 1)[-1].rsplit(".", 1)[0], side, side, image.shape[2], image.ravel().tolist()))
            yield pd.DataFrame(out, columns=["name", "height", "width", "channels", "values"])

    return found.mapInPandas(run, "name string, height int, width int, channels int, values array<short>")


def pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(name, image, mask) of pictures that have a mask of their name; image values are scaled to 1."""
    of = images.select("name", F.transform("values", lambda v: v / F.lit(255.0)).alias("image"))
    return of.join(masks.select("name", F.col("values").alias("mask")), "name")


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of (rows, columns, 1 or 3) unsigned bytes."""
    h, w, n = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + image[r].tobytes() for r in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
