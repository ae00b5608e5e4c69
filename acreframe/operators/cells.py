"""Joins of points on cells of a grid, where some cells hold most points.

Cells are counted first. A cell with more rows than ``most`` on its larger side is divided: rows of that side are dealt to its parts
by a hash, those of the other side go to each part. Cells that are not crowded have one part, so what is copied grows with the
crowds alone, and no task holds more than about ``most`` rows of a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreframe.config import SETTINGS


def crowded(rows: DataFrame, cell: Sequence[str], most: int) -> DataFrame:
    """(cell, _parts) of the cells with more than ``most`` rows."""
    return rows.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1")


def joined(many: DataFrame, few: DataFrame, cell: Sequence[str], on: Column, most: int = SETTINGS.crowd) -> DataFrame:
    """The inner join on the cell's columns and ``on``; ``many`` is the side that crowds, and is read twice."""
    crowds = crowded(many, cell, most)
    dealt = many.join(crowds, list(cell), "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    copied = few.join(crowds, list(cell), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    named = {c: f"_few_{c}" for c in (*cell, "_part")}
    copied = copied.withColumnsRenamed(named)
    same = on
    for c in (*cell, "_part"):
        same = same & (dealt[c] == copied[named[c]])
    return dealt.join(copied, same).drop(*named.values(), "_part")
