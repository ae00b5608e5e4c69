"""Label gates, balancing, near-duplicate points, joins of labels to tiles and pixels, label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreframe.config import NEGATIVE, POSITIVE, SETTINGS
from acreframe.operators import cells
from acreframe.sources.files import kept


def is_positive(label: Column) -> Column:
    """Positive by its lower-case name; anything else is negative."""
    return F.coalesce(F.lower(label) == POSITIVE.lower(), F.lit(False))


def summary(labels: DataFrame) -> DataFrame:
    """One row: total, positives, ratio (0 without labels), whether the gate holds and whether balancing is needed."""
    low, high = SETTINGS.ratio_range
    counts = labels.agg(F.count("*").alias("total"), F.count_if(is_positive(F.col("label"))).alias("agri"))
    rated = counts.withColumn("ratio", F.coalesce(F.try_divide(F.col("agri").cast("double"), F.col("total")), F.lit(0.0)))
    return rated.withColumns({"ok": (F.col("agri") >= SETTINGS.min_positives) & F.col("ratio").between(low, high), "needs_balance": F.col("ratio") < low})


def legacy_gate(labels: DataFrame) -> DataFrame:
    """One row: the legacy ratio gate, and whether there are positives enough to train."""
    low, high = SETTINGS.ratio_range
    return summary(labels).select("total", "agri", "ratio", F.col("ratio").between(low, high).alias("ratio_ok"), (F.col("agri") >= SETTINGS.legacy_min_positives).alias("enough"))


def hash_order(*parts) -> Column:
    """A seeded order that every engine agrees on."""
    return F.md5(F.concat_ws("|", F.lit(SETTINGS.seed), *[p.cast("string") for p in parts]))


def balanced(labels: DataFrame, key: str, ratio: float) -> DataFrame:
    """All positives, and negatives in hash order up to int((1 / ratio - 1) * positives).

    The hash rank needs one ordered pass; it is taken from counts of hash prefixes, so only the prefix at the limit is
    sorted, not all negatives.
    """
    marked = labels.withColumns({"_pos": is_positive(F.col("label")), "_h": hash_order(F.col(key))})
    prefix = F.substring("_h", 1, 3)
    counts = marked.groupBy(prefix.alias("_prefix")).agg(F.count_if(~F.col("_pos")).alias("_n"), F.count_if("_pos").alias("_p"))
    running = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    limits = counts.select("_prefix", "_n", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"), F.floor(F.round((1 / ratio - 1) * F.sum("_p").over(everything), 6)).alias("_most"))  # 4096 rows at most
    joined = marked.withColumn("_prefix", prefix).join(F.broadcast(limits), "_prefix")
    inside = joined.where("_pos or _before + _n <= _most")
    edge = joined.where("not _pos and _before < _most and _before + _n > _most")
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", key))).where("_before + _rank <= _most").drop("_rank")
    return inside.unionByName(edge).select(*labels.columns)


def near_duplicates(new: DataFrame, known: DataFrame, key: str, tolerance: float = SETTINGS.duplicate_degrees, keep_duplicates: bool = True, most: int = SETTINGS.crowd) -> DataFrame:
    """New points nearer than ``tolerance`` to a known one (strictly), or the others; points without place are never near.

    Nearness hangs on the place alone, so each place is looked at once. A place whose cell of half a tolerance a side holds a known
    one is near: the cell's diagonal is shorter than the tolerance. The other places meet known ones by an equi-join on cells a
    tolerance wide, known ones also standing in the eight cells around, with the distance as a residual test; cells where
    known places crowd are divided among tasks.
    """
    cell = lambda c, side: F.floor(F.col(c) / side).cast("long")
    half = lambda rows: rows.withColumns({"_hi": cell("lat", tolerance / 2), "_hj": cell("lon", tolerance / 2)})
    places = half(new.select("lat", "lon").where("lat is not null and lon is not null").distinct())
    there = half(known.select("lat", "lon").where("lat is not null and lon is not null").distinct())
    occupied = there.select("_hi", "_hj").distinct()
    surely = places.join(occupied, ["_hi", "_hj"], "left_semi").select("lat", "lon")
    others = places.join(occupied, ["_hi", "_hj"], "left_anti").select("lat", "lon", cell("lat", tolerance).alias("_ci"), cell("lon", tolerance).alias("_cj"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = there.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), cell("lat", tolerance).alias("_i"), cell("lon", tolerance).alias("_j"), around.alias("_o"))
    spread = spread.select("_lat", "_lon", (F.col("_i") + F.col("_o.i")).alias("_ci"), (F.col("_j") + F.col("_o.j")).alias("_cj"))
    met = cells.joined(spread, others, ["_ci", "_cj"], F.hypot(F.col("lat") - F.col("_lat"), F.col("lon") - F.col("_lon")) < tolerance, most).select("lat", "lon")
    near = surely.unionByName(met).distinct().select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return new.join(near, (new["lat"] == F.col("_lat")) & (new["lon"] == F.col("_lon")), "left_semi" if keep_duplicates else "left_anti")


def normalise_legacy(legacy: DataFrame) -> DataFrame:
    """Legacy labels in the form of current ones: the file's stem is the tile, ag is positive."""
    from acreframe.sources.files import tile_of

    tile = tile_of(F.col("image_file"))
    return legacy.select(F.concat_ws("_", tile, F.col("x").cast("string"), F.col("y").cast("string")).alias("id"), "lat", "lon", tile.alias("tile"), F.when(F.lower("label") == "ag", POSITIVE).otherwise(NEGATIVE).alias("label"))


def with_tile(labels: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with their tile's facts, labels of unknown tiles). Tiles are few and Spark broadcasts them if so."""
    key = F.lower("tile")
    facts = tiles.withColumn("_tile", key).drop("tile")
    return labels.join(facts, F.lower(labels["tile"]) == F.col("_tile")).drop("_tile"), labels.join(facts, F.lower(labels["tile"]) == F.col("_tile"), "left_anti")


def appended(master: DataFrame, more: DataFrame) -> DataFrame:
    """Labels of a round added to the working set by name, whatever their column order."""
    return master.unionByName(more.select(*master.columns))


def in_order(labels: DataFrame, order: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(labels with running counts, the counts that stand before each part of a group).

    Labels are dealt out by ranges of (group, order), so a group of any size is shared by many tasks. ``_p`` and ``_n`` count
    the positives and negatives of a label's part up to itself; ``_p0`` and ``_n0`` those of the group's earlier parts.
    """
    marked = labels.withColumn("_pos", is_positive(F.col("label")))
    dealt = kept(marked.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()), "labels")
    window = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumns({"_p": F.count_if("_pos").over(window), "_n": F.count_if(~F.col("_pos")).over(window)})
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sums = dealt.groupBy(by, "_part").agg(F.count_if("_pos").alias("_ps"), F.count_if(~F.col("_pos")).alias("_ns"))
    sums = sums.select(by, "_part", F.coalesce(F.sum("_ps").over(before), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_ns").over(before), F.lit(0)).alias("_n0"))
    return counted, sums


def running_ratio(labels: DataFrame, order: str, by: str) -> DataFrame:
    """Share of positives among the labels before each one, within a group."""
    counted, sums = in_order(labels, order, by)
    positive = F.col("_p0") + F.col("_p") - F.col("_pos").cast("int")
    all_ = F.col("_p0") + F.col("_n0") + F.col("_p") + F.col("_n") - 1
    ratio = F.coalesce(F.try_divide(positive.cast("double"), all_), F.lit(0.0))
    return counted.join(sums, [by, "_part"]).select(*labels.columns, ratio.alias("ag_ratio"))


def refused(labels: DataFrame, order: str, by: str) -> DataFrame:
    """Labels that the legacy loop takes, in order: a negative is refused while the share of positives taken is below 0.25.

    All positives are taken, so p of them allow 3 p + 1 negatives, and none where p is 0: the number of negatives taken goes up
    by one with each negative, but not above that. Such a count is the number of negatives so far, less the most by which
    that has been above what was allowed; so a running minimum of (allowed - negatives) tells every decision, without a loop.
    """
    each = round(1 / SETTINGS.legacy_balance_ratio) - 1
    counted, sums = in_order(labels, order, by)
    slack = F.when(~F.col("_pos"), each * F.col("_p") + 1 - F.col("_n"))
    earlier = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_slack", slack).withColumn("_before", F.min("_slack").over(earlier))
    least = counted.groupBy(by, "_part").agg(F.min("_slack").alias("_least")).join(sums, [by, "_part"])
    parts = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = least.withColumn("_m0", F.min(each * F.col("_p0") - F.col("_n0") + F.col("_least")).over(parts)).drop("_least")
    joined = counted.join(known, [by, "_part"])
    p, n = F.col("_p0") + F.col("_p"), F.col("_n0") + F.col("_n")
    # Negatives before the first positive are all refused: one more than the slack of the last of them says.
    head = joined.where("_pos").groupBy(F.col(by).alias("_by")).agg(F.min(n).alias("_head"))
    joined = joined.join(head, joined[by].eqNullSafe(F.col("_by")), "left")
    taken = n - 1 + F.least(F.lit(0), -F.col("_head"), F.coalesce("_m0", F.lit(0)), F.coalesce(each * F.col("_p0") - F.col("_n0") + F.col("_before"), F.lit(0)))
    return joined.where(F.col("_pos") | ((p > 0) & (taken <= each * p))).select(by, order)


def answered(candidates: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Candidates with the label that the answers give them; those without an answer stay pending."""
    known = answers.select(F.col(key).alias("_key"), F.col("label").alias("_label"))
    joined = candidates.join(known, F.col(key) == F.col("_key"), "left")
    pending = F.trim(F.coalesce("label", F.lit(""))) == ""
    return joined.select(*[F.when(pending, F.coalesce("_label", F.lit(""))).otherwise(F.col("label")).alias("label") if c == "label" else F.col(c) for c in candidates.columns])


def add_batch(master: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Labels and a batch of new ones, less those that are near a label already there."""
    return appended(master, near_duplicates(new, master, key, keep_duplicates=False))


def manual(points: DataFrame, tiles: DataFrame, key: str, cell: float, a: float) -> DataFrame:
    """(key, tile, x, y, lat, lon, label) of points given by hand: the first tile whose box holds them, and the column and row
    of its grid of ``a`` degrees; points outside all tiles are left out."""
    from acreframe.operators.grid import tile_of_point

    placed = tile_of_point(points, tiles, key, cell).where("tile is not null")
    box = tiles.select(F.col("tile").alias("_tile"), "x0", "y1")
    found = placed.join(box, placed["tile"] == F.col("_tile"))
    return found.select(key, "tile", F.floor((F.col("lon") - F.col("x0")) / a).cast("int").alias("x"), F.floor((F.col("y1") - F.col("lat")) / a).cast("int").alias("y"), "lat", "lon", "label")
