"""Export tasks followed as a stream: the last state of each, and tasks that have said nothing for long.

Events (task, state, ts) come in any order, late and repeated. Each task's last event is its state, kept by Spark; an event changes it
only if it is later, or equally late and later by name, as in ``plans/exports.task_states``. A task that is not in a final state has a
timer, which goes off when the watermark passes its last event by ``patience``: then the task is told as stalled, until it is heard of again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from acreframe.plans.exports import DONE, FAILED

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastState(StatefulProcessor):
    """State of a task: (microseconds of its last event, that event's state)."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.last.get()) if self.last.exists() else None
        found = max([held] * (held is not None) + [(int(us), s) for pdf in rows for us, s in zip(pdf["us"], pdf["state"], strict=True)])
        if found != held:
            self.last.update(found)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if found[1] not in (DONE, FAILED):
                self.handle.registerTimer(found[0] // 1000 + self.patience_ms)
            yield self._row(key, found, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.last.get()), True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, last: tuple[int, str], stalled: bool) -> pd.DataFrame:
        return pd.DataFrame({"task": [str(key[0])], "state": [last[1]], "us": [last[0]], "stalled": [stalled]})


def prepare(spark: SparkSession) -> None:
    """Let the session keep states in the store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def followed(events: DataFrame, delay: str = "1 hour", patience_ms: int = 6 * 3_600_000) -> DataFrame:
    """Changes (task, state, ts, stalled) of the stream's tasks; events without task, state or time are left out.

    Events that come more than ``delay`` behind the latest one may be dropped.
    """
    prepare(events.sparkSession)
    known = events.where("task is not null and state is not null and ts is not null").select(F.col("task").cast("string").alias("task"), "state", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    timed = known.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    changes = timed.groupBy("task").transformWithStateInPandas(LastState(patience_ms), "task string, state string, us long, stalled boolean", "Update", "EventTime")
    return changes.select("task", "state", F.timestamp_micros("us").alias("ts"), "stalled")


def run(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Append the changes that are there to a table, from where the checkpoint says; each is written once, by batch."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/of={number}")

    changes.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(task, state, stalled) after all changes written so far: the last change of each task."""
    changes = spark.read.schema("task string, state string, ts timestamp, stalled boolean, batch int").parquet(path)
    last = changes.groupBy("task").agg(F.max(F.struct("ts", "state", "batch", "stalled")).alias("l"))
    return last.select("task", F.col("l.state").alias("state"), F.col("l.stalled").alias("stalled"))
