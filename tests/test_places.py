"""Points that crowd in a cell, and rasters put onto another grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreframe.functions import geo
from acreframe.operators import cells, grid, labels, warp


def crowd(n, seed, centre=0.0):
    """Half of all points within three tolerances, the others far apart; some repeat, some have no place."""
    r = np.random.default_rng(seed)
    near = centre + r.uniform(-1.5, 1.5, (n // 2, 2))
    points = np.concatenate([near, r.uniform(-500, 500, (n - n // 2, 2))]).round(2)
    return [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(points)] + [("twin", *map(float, points[0])), ("lost", None, 1.0)]


@pytest.mark.parametrize("most", [3, 10_000])
def test_near_points_where_most_stand_in_one_cell(spark, most):
    new, known = crowd(300, 1, 2.0), crowd(200, 2)
    frames = [spark.createDataFrame(x, "id string, lat double, lon double").repartition(4) for x in (new, known)]
    want = {i for i, a, b in new if a is not None and any(c is not None and math.hypot(a - c, b - d) < 1.0 for _, c, d in known)}
    got = [r.id for r in labels.near_duplicates(*frames, "id", 1.0, most=most).collect()]
    rest = [r.id for r in labels.near_duplicates(*frames, "id", 1.0, keep_duplicates=False, most=most).collect()]
    assert len(got) == len(want) and set(got) == want and sorted(got + rest) == sorted(i for i, _, _ in new)
    assert 0 < len(want) < len(new) and {"lost"} <= set(rest)


def test_tiles_of_points_where_most_stand_in_one_cell(spark):
    points = crowd(300, 3)
    boxes = [("a", -1.0, -1.0, 0.5, 0.5), ("b", 0.0, 0.0, 2.0, 2.0), ("c", -400.0, -400.0, 100.0, -100.0)]
    tiles = spark.createDataFrame(boxes, "tile string, x0 double, y0 double, x1 double, y1 double")
    frame = spark.createDataFrame(points, "id string, lat double, lon double").repartition(4)
    want = sorted((i, min((t for t, x0, y0, x1, y1 in boxes if lat is not None and x0 <= lon <= x1 and y0 <= lat <= y1), default=None)) for i, lat, lon in points)
    for most in (5, 10_000):
        assert sorted((r.id, r.tile) for r in grid.tile_of_point(frame, tiles, "id", 60.0, most).collect()) == want


def test_a_crowded_cell_is_divided(spark):
    many = spark.range(1000).select(F.lit(0).alias("x"), F.col("id"))
    few = spark.createDataFrame([(0, "k"), (1, "l")], "x int, v string")
    assert [tuple(r) for r in cells.crowded(many, ["x"], 100).collect()] == [(0, 10)]
    got = cells.joined(many, few, ["x"], F.lit(True), 100)
    assert sorted(got.columns) == ["id", "v", "x"] and sorted(r.id for r in got.collect()) == list(range(1000))
    assert got.where("v <> 'k'").count() == 0


@pytest.fixture(scope="module")
def source(spark):
    """A raster of 30 by 20 cells in degrees, with a gap."""
    values = np.random.default_rng(5).random((30, 20)).round(4)
    rows = [("t", r, c, float(values[r, c])) for r in range(30) for c in range(20) if (r, c) != (12, 7)]
    tiles = spark.createDataFrame([("t", -22.9, 16.1, 0.0001, 30, 20)], "tile string, lon0 double, lat0 double, step double, height int, width int")
    return values, spark.createDataFrame(rows, "tile string, r long, c long, v double"), tiles


def places(spark, tiles):
    """{target cell: place of its centre in the source} by the column expressions, a cell at a time."""
    lat, lon = geo.from_utm(F.col("x"), F.col("y"))
    found = warp.target_cells(tiles).select("gx", "gy", ((16.1 - lat) / 0.0001).alias("fr"), ((lon + 22.9) / 0.0001).alias("fc")).collect()
    return {(r.gx, r.gy): (r.fr, r.fc) for r in found if 0 <= r.fr < 30 and 0 <= r.fc < 20}


def test_nearest_source_cells(spark, source):
    values, pixels, tiles = source
    want = {k: (int(fr), int(fc)) for k, (fr, fc) in places(spark, tiles).items()}
    got = {(x.gx, x.gy): (x.r, x.c, x.v) for x in warp.nearest(pixels, tiles, ["v"]).collect()}
    assert got == {k: (r, c, values[r, c]) for k, (r, c) in want.items() if (r, c) != (12, 7)} and 600 < len(got) < 800
    covered = {k for k, v in want.items()}
    assert {(gx, gy) for gx in range(min(x for x, _ in covered), max(x for x, _ in covered) + 1) for gy in [max(y for x, y in covered if x == gx)]} <= covered


def test_bilinear_means(spark, source):
    values, pixels, tiles = source
    got = {(x.gx, x.gy): x.v for x in warp.bilinear(pixels, tiles, ["v"]).collect()}
    want = {}
    for k, (fr, fc) in places(spark, tiles).items():
        r, c = fr - 0.5, fc - 0.5
        near = [(min(max(int(np.floor(r)) + a, 0), 29), min(max(int(np.floor(c)) + b, 0), 19), abs(1 - a - (r - np.floor(r))) * abs(1 - b - (c - np.floor(c)))) for a in (0, 1) for b in (0, 1)]
        if (12, 7) not in {(i, j) for i, j, _ in near}:
            want[k] = sum(values[i, j] * w for i, j, w in near)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_plane_stays_a_plane(spark):
    """Values that grow evenly with longitude and latitude come out as they are at each centre, away from the border."""
    tiles = spark.createDataFrame([("t", -22.9, 16.1, 0.0001, 30, 20)], "tile string, lon0 double, lat0 double, step double, height int, width int")
    pixels = spark.range(600).select(F.lit("t").alias("tile"), F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c")).withColumn("v", 3.0 * (F.col("r") + 0.5) - 2.0 * (F.col("c") + 0.5))
    got = {(x.gx, x.gy): x.v for x in warp.bilinear(pixels, tiles, ["v"]).collect()}
    inner = {k: (r, c) for k, (r, c) in places(spark, tiles).items() if 0.5 <= r <= 29.5 and 0.5 <= c <= 19.5}
    assert len(inner) > 400 and all(abs(got[k] - (3 * r - 2 * c)) < 1e-6 for k, (r, c) in inner.items())


def test_resampling_across_blocks(spark, source, monkeypatch):
    """Blocks of 7 cells give what one block gives, pixels meet in one shuffle, and target cells in none."""
    values, pixels, tiles = source
    holes = pixels.withColumn("w", F.when(F.col("r") != 20, F.col("v")))
    whole = [sorted(map(tuple, f(holes, tiles, ["v", "w"]).collect()), key=str) for f in (warp.nearest, warp.bilinear)]
    monkeypatch.setattr(warp, "BLOCK", 7)
    parts = [f(holes, tiles, ["v", "w"]) for f in (warp.nearest, warp.bilinear)]
    assert [sorted(map(tuple, p.collect()), key=str) for p in parts] == whole and any(x[-1] is None for x in whole[1])
    for p in parts:
        plan = p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
