"""The labelling rounds as streams, an addition: labels arrive as files, pixels are scored as their files appear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe import schema


def label_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a folder, each id once."""
    return spark.readStream.schema(schema.LABEL).option("header", True).csv(folder).dropDuplicates(["id"])


def label_counts(labels: DataFrame) -> DataFrame:
    """Running counts of positives and all labels of each tile."""
    return labels.groupBy("tile").agg(F.count("*").alias("total"), F.count_if(F.lower("label") == "agricultural").alias("agri"))


def score_stream(pixels: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score pixel files as they come and append the predictions, each micro-batch once."""

    def each(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return pixels.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
