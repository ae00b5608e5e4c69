"""Candidates for labelling: margins, uncertainty, deterministic random picks, unions of candidate lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.operators.labels import hash_order


def margin(predictions: DataFrame, p: str = "p") -> DataFrame:
    return predictions.where(F.col(p).between(*SETTINGS.margin))


def most_uncertain(predictions: DataFrame, order: Sequence[str], p: str = "p", n: int = SETTINGS.candidates_per_round) -> DataFrame:
    """The n rows nearest to probability 0.5, in scan order where they tie: a distributed top-n."""
    return predictions.withColumn("uncertainty", F.abs(F.col(p) - 0.5)).orderBy("uncertainty", *order).limit(n)


def round_candidates(predictions: DataFrame, order: Sequence[str], n: int = SETTINGS.candidates_per_round) -> DataFrame:
    """The first n of the margin in scan order, or the n most uncertain rows where the margin holds fewer.

    Both are top-n of one plan; which one counts is told by the number of the first, on 2 n rows.
    """
    inside = margin(predictions).orderBy(*order).limit(n).select(*predictions.columns, F.lit(0).alias("_list"))
    near = most_uncertain(predictions, order, n=n).select(*predictions.columns, F.lit(1).alias("_list"))
    both = inside.unionByName(near).withColumn("_inside", F.count_if(F.col("_list") == 0).over(Window.partitionBy(F.lit(1))))
    return both.where(F.col("_list") == F.when(F.col("_inside") >= n, 0).otherwise(1)).select(*predictions.columns)


def random_per_group(rows: DataFrame, by: str, key: Sequence[str], n: int = SETTINGS.random_per_tile) -> DataFrame:
    """n rows of each group in hash order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(*[F.col(k) for k in key])))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def latest_round(rows: DataFrame, column: str = "round") -> DataFrame:
    """Rows of the latest round: its number is one aggregate, and prunes partitions where rounds are folders."""
    last = rows.agg(F.max(column).alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col(column) == F.col("_last")).drop("_last")


def union_candidates(lists: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Candidates of several lists, the first of those at one place (tile, and degrees to six places) with its prefix.

    Ids number the candidates of a list within their tile.
    """
    tagged = [rows.select("tile", F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), F.lit(i).alias("_list"), F.lit(prefix).alias("prefix")) for i, (prefix, rows) in enumerate(lists)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    first = whole.groupBy("tile", "lat", "lon").agg(F.min(F.struct("_list", "prefix")).alias("_first"))
    number = F.row_number().over(Window.partitionBy("tile", F.col("_first._list")).orderBy("lat", "lon")) - 1
    return first.select(F.concat_ws("_", F.col("_first.prefix"), F.col("tile"), number.cast("string")).alias("id"), "tile", "lat", "lon", F.lit("").alias("label"))


def shuffled(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with ``_h``, their seeded hash, and ``place``, their rank by it from 1 on.

    Ranks come from counts of hash prefixes, at most 4096, and a rank within the prefix, so no task sorts all rows.
    """
    hashed = rows.withColumn("_h", hash_order(*[F.col(k) for k in key])).withColumn("_prefix", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_prefix").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_prefix", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", *key))
    return hashed.join(F.broadcast(before), "_prefix").withColumn("place", place).drop("_prefix", "_before")


def split(rows: DataFrame, key: Sequence[str], share: float = 0.8) -> DataFrame:
    """``part`` train for the first floor(share * n) rows in hash order, else validation: an exact split."""
    whole = rows.agg(F.count("*").alias("_all"))  # one row
    ranked = shuffled(rows, key).withColumnRenamed("place", "rank").crossJoin(F.broadcast(whole))
    return ranked.withColumn("part", F.when(F.col("rank") <= F.floor(share * F.col("_all")), "train").otherwise("validation")).drop("_h", "_all")


def roi_points(boxes: DataFrame, n: int) -> DataFrame:
    """n points of each box, uniform by hash: 32 bits of an md5 for either axis."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = lambda axis: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SETTINGS.seed), F.col("name"), F.lit(axis), F.col("k").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return boxes.withColumn("k", k).select("name", "k", (F.col("x0") + unit("lon") * (F.col("x1") - F.col("x0"))).alias("lon"), (F.col("y0") + unit("lat") * (F.col("y1") - F.col("y0"))).alias("lat"))


def random_cells(tiles: DataFrame, n: int) -> DataFrame:
    """n cells of each tile (tile, height, width) with replacement, by hash."""
    bits = lambda part: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SETTINGS.seed), F.col("tile").cast("string"), F.lit(part), F.col("k").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("tile", "k", (bits("r") % F.col("height")).alias("r"), (bits("c") % F.col("width")).alias("c"))
