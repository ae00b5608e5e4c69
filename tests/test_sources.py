"""Windowed reads, scene collections with pushed filters, and writers that publish all files or none."""

import glob
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreframe.operators import patches
from acreframe.sources import geotiff, rasters, scenes, sinks, windows

TRANSFORM = (10.0, 0.0, 200000.0, 0.0, -10.0, 1840000.0)


@pytest.fixture(scope="module")
def tiles(spark):
    """Two tiles of 60 by 400 cells, with a missing cell in ten."""
    cells = spark.range(48_000).select((F.col("id") % 2).alias("tile"), F.floor(F.col("id") / 2 / 400).cast("long").alias("r"), (F.floor(F.col("id") / 2) % 400).cast("long").alias("c"), (F.xxhash64("id") / 1e18).alias("a"), (F.xxhash64("id", F.lit(1)) / 1e18).alias("b"))
    return cells.where("(r * 7 + c) % 10 <> 0")


@pytest.fixture(scope="module")
def folder(tiles, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('rasters')}"
    assert sinks.write_rasters(tiles, ["a", "b"], path, 60, 400, TRANSFORM, strip_rows=5).agg(F.sum("pixels")).first()[0] == tiles.count()
    return path


def test_windows_of_files_are_those_of_tables(spark, tiles, folder):
    index = windows.geometry(spark, folder)
    assert sorted(map(tuple, index.drop("path").collect())) == [("tile_0", 60, 400, 5, 400), ("tile_1", 60, 400, 5, 400)]
    points = spark.createDataFrame([("in", 0, 30, 20), ("corner", 1, 0, 399), ("edge", 1, 59, 3), ("out", 0, 60, 3), ("none", 7, 1, 1), ("twin", 0, 30, 20)], "key string, tile long, r long, c long")
    for side in (1, 3, 7):
        want = {r.key: r.features for r in patches.window_features(points.where("r < 60 and tile < 7"), tiles, ["a", "b"], 60, 400, side).collect()}
        named = points.withColumn("tile", F.concat(F.lit("tile_"), F.col("tile").cast("string")))
        got = {r.key: r.features for r in windows.read_windows(named, index, [0, 1], side).collect()}
        assert got == want and set(got) == {"in", "corner", "edge", "twin"}


def test_a_file_is_shared_by_tasks(spark, tiles, folder):
    """Whole reads are dealt out by block, and give every pixel once."""
    got = windows.read_pixels(spark, folder)
    assert got.where("tile = 'tile_0'").select(F.spark_partition_id()).distinct().count() > 1 and got.count() == 2 * 60 * 400
    want = tiles.where("tile = 1").select("r", "c", F.round("a", 6), F.round("b", 6))
    there = got.where("tile = 'tile_1' and features[0] is not null").select(F.col("row").cast("long"), F.col("col").cast("long"), F.round(F.col("features")[0], 6), F.round(F.col("features")[1], 6))
    assert want.exceptAll(there).isEmpty() and there.exceptAll(want).isEmpty()


def test_bytes_read_grow_with_the_cells(spark, folder):
    index = windows.geometry(spark, folder)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{folder.removeprefix('file://')}/*.tif"))
    cells = lambda rows: spark.createDataFrame([(t, r, c) for t in ("tile_0", "tile_1") for r in rows for c in (0, 399)], "tile string, r long, c long")
    read = [windows.read_cells(cells(range(n)), index, [1]).agg(F.sum("read")).first()[0] for n in (1, 5, 10, 60)]
    assert read[0] == read[1] and 1.5 * read[1] < read[2] < 3 * read[1] and 8 * read[1] < read[3] < size  # one of two bands is read
    assert windows.read_cells(cells([]), index, [0]).count() == 0


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
def test_blocks_by_range_are_those_of_the_whole_file(tmp_path, compression):
    image = np.random.default_rng(2).integers(0, 200, (3, 37, 21)).astype("uint16")
    (tmp_path / "x.tif").write_bytes(data := geotiff.encode(image, TRANSFORM, compression, 2, strip_rows=8))
    lazy = windows.Ranges(str(tmp_path / "x.tif"))
    blocks = geotiff.Blocks.of(*geotiff.tags_of(lazy))
    for cell in range(blocks.cells):
        r, c = blocks.origin(cell)
        assert (blocks.read(lazy, cell, [2, 0]) == image[[2, 0], r : r + 8, c:]).all()
    assert (geotiff.decode(data)[0] == image).all()


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('scenes')}/all"
    rows = spark.range(4000).select(
        (F.col("id") % 8).alias("tile"), (F.col("id") % 5).alias("r"), (F.col("id") % 3).alias("c"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("ts"),
        F.lit(1).alias("season"), F.col("id").alias("qa"), F.when(F.col("tile") < 7, F.col("tile") * 10 + F.col("id") % 5).cast("double").alias("cloud_pct"), *[F.col("id").cast("double").alias(b) for b in ("B2", "B3", "B4", "B8", "B11", "B12")],
    )
    scenes.write_scenes(rows, path)
    return path, rows


def test_scenes_come_back(spark, collection):
    path, rows = collection
    got = scenes.read_scenes(spark, path)
    assert got.count() == 4000 and got.exceptAll(rows.select(got.columns)).isEmpty()
    listed = scenes.listed(path)
    assert len(listed) == 8 * 28 == len(glob.glob(f"{path.removeprefix('file://')}/*.parquet"))
    scenes.write_scenes(rows.where("tile = 0"), path)  # more is appended
    assert scenes.read_scenes(spark, path).count() == 4500
    scenes.write_scenes(rows, path, "overwrite")
    assert scenes.read_scenes(spark, path).count() == 4000 and len(glob.glob(f"{path.removeprefix('file://')}/*.parquet")) == 224


def test_filters_go_to_the_source_and_other_files_are_not_opened(spark, collection, tmp_path, capfd):
    path, rows = collection
    local = str(tmp_path / "copy")
    subprocess.run(["cp", "-r", path.removeprefix("file://"), local], check=True)
    wanted = "tile in (1, 2) and ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-08 12:00:00' and cloud_pct < 15"
    for f in scenes.listed(f"file://{local}"):
        if not f.name.startswith("scene-1-2024010"):
            open(f"{local}/{f.name}", "wb").write(b"not a scene")
    found = scenes.read_scenes(spark, f"file://{local}").where(wanted)
    want = rows.where(wanted)
    assert found.count() == want.count() > 0 and found.exceptAll(want.select(found.columns)).isEmpty()
    found.explain()
    plan = capfd.readouterr().out
    assert "BatchScan acreframe_scenes" in plan
    assert found.rdd.getNumPartitions() == 4  # a partition for each scene file that may hold rows
    assert scenes.read_scenes(spark, f"file://{local}").where("tile = 77").count() == 0


@pytest.mark.parametrize(("low", "high", "kind", "value", "held"), [(1, 5, scenes.EqualTo, 5, True), (1, 5, scenes.EqualTo, 6, False), (1, 5, scenes.GreaterThan, 5, False), (1, 5, scenes.GreaterThanOrEqual, 5, True), (1, 5, scenes.LessThan, 1, False), (1, 5, scenes.LessThanOrEqual, 1, True), (1, 5, scenes.In, (0, 7), False), (1, 5, scenes.In, (0, 3), True), (None, None, scenes.LessThan, 1, False)])
def test_bounds_tell_what_a_file_may_hold(low, high, kind, value, held):
    assert scenes.may_hold({"r": (low, high)}, kind(("r",), value)) is held


def test_a_write_that_fails_leaves_nothing(spark, tiles, collection, tmp_path):
    bad = tiles.withColumn("a", F.when((F.col("tile") == 1) & (F.col("r") == 40), F.raise_error(F.lit("broken"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_rasters(bad, ["a"], f"file://{tmp_path}/r", 60, 400, TRANSFORM)
    assert glob.glob(f"{tmp_path}/r/**", recursive=True, include_hidden=True) in ([], [f"{tmp_path}/r/"])
    rows = collection[1].withColumn("B2", F.when(F.col("qa") == 3999, F.raise_error(F.lit("broken"))).otherwise(F.col("B2")))
    with pytest.raises(Exception, match="broken"):
        scenes.write_scenes(rows, f"file://{tmp_path}/s")
    assert not glob.glob(f"{tmp_path}/s/*")


def test_attempts_that_did_not_count_are_not_published(tiles, tmp_path):
    """Two attempts of a task write the same tile; the commit knows one of them."""
    form = {"bands": ["v"], "height": 2, "width": 2, "transform": list(TRANSFORM), "dtype": "uint8", "compression": "lzw", "predictor": 1, "nodata": None, "epsg": None, "named": False, "strip_rows": 2, "prefix": "", "suffix": "", "on": 1, "count": "set"}
    writer = rasters.RasterWriter(f"file://{tmp_path}/m", form)
    import pyarrow as pa

    batch = lambda v: pa.RecordBatch.from_pydict({"tile": ["x"], "r": [0], "c": [1], "v": [v]})
    writer.write(iter([batch(7.0)]))
    writer.commit([writer.write(iter([batch(9.0)])), None])
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/m/*", include_hidden=True)) == sorted([f"tiles-{writer.token}.json", "x.tif"])
    assert geotiff.decode((tmp_path / "m" / "x.tif").read_bytes())[0].tolist() == [[[0, 9], [0, 0]]]
    twice = rasters.RasterWriter(f"file://{tmp_path}/m", form)
    with pytest.raises(ValueError, match="more than one task"):
        twice.commit([twice.write(iter([batch(1.0)])), twice.write(iter([batch(2.0)]))])
    with pytest.raises(ValueError, match="apart"):
        twice.write(iter([batch(1.0), pa.RecordBatch.from_pydict({"tile": ["y"], "r": [0], "c": [1], "v": [1.0]}), batch(1.0)]))


def test_a_task_that_fails_once_leaves_one_file_a_tile(tmp_path):
    """A session of its own, whose tasks may run three times; each task dies once behind half of its rows."""
    script = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession, functions as F
        from acreframe.sources import scenes, sinks

        spark = SparkSession.builder.master("local[2,3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
        pixels = spark.range(4000).selectExpr("id % 4 as tile", "id div 4 div 25 as r", "id div 4 % 25 as c", "cast(id as double) as v", "timestamp_seconds(id * 40) as ts", "1 as season", "id as qa", "1.0 as cloud_pct", *[f"id + 0.5 as B{{b}}" for b in (2, 3, 4, 8, 11, 12)])

        def once(name):
            def run(batches):
                from pyspark import TaskContext
                mark = "{tmp_path}/" + name + str(TaskContext.get().partitionId())
                for batch in batches:
                    yield batch.slice(0, batch.num_rows // 2)
                    if not os.path.exists(mark):
                        open(mark, "w").close()
                        raise ValueError("lost")
                    yield batch.slice(batch.num_rows // 2)
            return run

        dealt = pixels.repartition("tile").sortWithinPartitions("tile", "ts")
        scenes.register(spark)
        keep = scenes.StructType.fromDDL(scenes.SCHEMA).names
        dealt.select([F.col(n).cast(k.split()[1]) if n != "ts" else F.col(n) for n, k in zip(keep, scenes.SCHEMA.split(", "))]).mapInArrow(once("s"), scenes.SCHEMA).write.format(scenes.FORMAT).mode("append").option("path", "file://{tmp_path}/scenes").save()
        print("SCENES", scenes.read_scenes(spark, "file://{tmp_path}/scenes").count(), len(scenes.listed("file://{tmp_path}/scenes")))
        print("TILES", sinks.write_rasters(pixels.mapInArrow(once("r"), pixels.schema), ["v"], "file://{tmp_path}/tiles", 40, 25, {TRANSFORM}).count())
    """)
    told = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ)
    assert "SCENES 4000 8" in told.stdout and "TILES 4" in told.stdout, told.stderr[-3000:]
    assert len(glob.glob(f"{tmp_path}/s[0-9]*")) >= 1 and len(glob.glob(f"{tmp_path}/r[0-9]*")) >= 1  # tasks did die
    assert len(glob.glob(f"{tmp_path}/scenes/*.parquet")) == 8 and len(glob.glob(f"{tmp_path}/tiles/*.tif")) == 4 and not glob.glob(f"{tmp_path}/tiles/.*")
