"""Exports of tiles as tasks with states: what an outside queue did by submitting and polling.

A task writes one region's tiles; its states are rows of a table (task, state, ts), and the state of a task is its last row.
Writing is a Spark job, so a region's tasks are done when its job is; what failed is told apart by its state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreframe.sources.sinks import exists

DONE, FAILED = "COMPLETED", "FAILED"


def check_setup(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ok) of the inputs that a run needs: the check before anything starts."""
    return spark.createDataFrame([(p, exists(spark, p)) for p in paths], "path string, ok boolean")


def task_states(events: DataFrame) -> DataFrame:
    """(task, state) of each task: that of its last event, of several at one time the last by name."""
    return events.groupBy("task").agg(F.max(F.struct("ts", "state")).alias("_last")).select("task", F.col("_last.state").alias("state"))


def all_done(states: DataFrame) -> DataFrame:
    """One row: the number of tasks, of those in a final state, and whether all are."""
    final = F.col("state").isin(DONE, FAILED)
    return states.agg(F.count("*").alias("tasks"), F.count_if(final).alias("final")).withColumn("done", F.col("tasks") == F.col("final"))


def export_regions(spark: SparkSession, regions: list[str], write: Callable[[str, str], None], folder: str) -> list[tuple[str, str]]:
    """Write each region's tiles to ``folder/region`` unless they are there; (region, state) of each. One failure stops no other region."""
    out = []
    for name in regions:
        path = f"{folder}/{name}"
        try:
            if not exists(spark, f"{path}/_SUCCESS"):
                write(name, path)
            out.append((name, DONE))
        except Exception as e:  # a task that fails is told by its state
            out.append((name, f"{FAILED}: {type(e).__name__}"))
    return out
