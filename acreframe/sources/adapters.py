"""Rasters, scenes, labels and features from generic tables, by integer arithmetic so that any engine agrees on them.

A tile is made up of four suppliers' order lines, or of four users' events, so the number of tiles grows with the tables
while that of a tile's cells stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, r, c, n, p, blue, green, red, nir, swir1, swir2): a cell for each group of order lines.

    Bands are sums of whole numbers over a count, so no engine's order of summation shows; p lies in [0, 1].
    """
    n = F.count(F.lit(1))

    def mean(of, scale=1e0):
        return F.sum(of.cast("bigint")) / (F.lit(scale) * n)

    col = F.col
    keyed = read(spark, folder, "lineitem").withColumns({"tile": F.expr("l_suppkey div 4"), "r": col("l_partkey") % 40, "c": col("l_orderkey") % 40})
    return keyed.groupBy("tile", "r", "c").agg(
        n.alias("n"),
        mean(F.round(col("l_discount") * 100), 10e0).alias("p"),
        mean(col("l_linenumber")).alias("blue"),
        mean(col("l_partkey") % 100).alias("green"),
        mean(F.round(col("l_tax") * 100)).alias("red"),
        mean(F.round(col("l_quantity"))).alias("nir"),
        mean(col("l_suppkey") % 50).alias("swir1"),
        mean(col("l_orderkey") % 70).alias("swir2"),
    )


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles that ``pixels`` has, each once, without counting their cells."""
    return read(spark, folder, "lineitem").select(F.expr("l_suppkey div 4").alias("tile")).distinct()


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(tile, r, c, ts, season, qa, cloud_pct, six bands): an observation for each event."""
    col = F.col
    e = read(spark, folder, "events")
    season = F.when(col("ts") < F.lit("2024-01-11").cast("timestamp"), 1).when(col("ts") < F.lit("2024-01-21").cast("timestamp"), 2).otherwise(3)
    bands = {b: ((col("event_id") * k) % 1000).cast("double") for b, k in (("B3", 7), ("B4", 13), ("B8", 17), ("B11", 19), ("B12", 23))}
    return e.select(
        F.expr("user_id div 4").alias("tile"),
        (col("event_id") % 4).alias("r"),
        F.floor((col("event_id") % 16) / 4).cast("bigint").alias("c"),
        col("ts"),
        season.alias("season"),
        (col("event_id") % 4096).alias("qa"),
        (col("value") / 5).alias("cloud_pct"),
        (F.round(col("value") * 100).cast("bigint") % 1000).cast("double").alias("B2"),
        *[v.alias(k) for k, v in bands.items()],
    )


def label_points(spark: SparkSession, folder: str) -> DataFrame:
    """(id, lat, lon, tile, label, k): a labelled point for each label; toxic ones count as agricultural."""
    k = F.col("doc_id")
    return read(spark, folder, "labels").select(
        F.concat(F.lit("rand_"), k.cast("string")).alias("id"),
        ((16644662 + (k * 37) % 7842) / 1e6).alias("lat"),
        ((-24400884 + (k * 53) % 7930) / 1e6).alias("lon"),
        F.concat(F.lit("tile"), (k % 10).cast("string")).alias("tile"),
        F.when(F.col("toxic") == 1, "Agricultural").otherwise("Non-Agricultural").alias("label"),
        k.alias("k"),
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, y, f0..f7): eight features as doubles, missing where vec_id is divisible by 7 (in f0 and f3)."""
    e = read(spark, folder, "embeddings")
    cols = [F.when(F.col("vec_id") % 7 != 0, F.col("embedding")[i].cast("double")).alias(f"f{i}") if i in (0, 3) else F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(8)]
    return e.select("vec_id", (F.col("label") < 3).cast("int").alias("y"), *cols)


FEATURES = [f"f{i}" for i in range(8)]
