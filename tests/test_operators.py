"""Hand-made cases with answers from paper, and properties that must hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.functions import geo, images, stats
from acreframe.functions import indices as X
from acreframe.operators import composite, grid, labels, models, patches, patchnet, regions, sampling
from acreframe.plans import exports, rounds
from acreframe.sources import files, geotiff, sinks, windows
from acreframe.sources.adapters import FEATURES, features, pixels
from acreframe import schema
from tests.conftest import DATA


def cells(spark, *lines, tile=0):
    rows = [(tile, r, c, int(v)) for r, line in enumerate(lines) for c, v in enumerate(line) if v != " "]
    return spark.createDataFrame(rows, "tile int, r long, c long, v int")


def test_components_by_connectivity(spark):
    m = cells(spark, "10", "01")
    assert regions.component_sizes(m, 4).count() == 2
    assert regions.component_sizes(m, 8).count() == 1


def test_ring_with_a_hole(spark):
    m = cells(spark, "111", "101", "111")
    p = regions.polygons(m).collect()
    assert len(p) == 1 and p[0].outer_area == 9 and p[0].net_area == 8 and p[0].holes == 1
    assert regions.sieve(m, 2).agg(F.sum("v")).first()[0] == 9


@pytest.mark.parametrize("lines, n", [(["1"], 1), (["1011"], 2), (["1", "0", "1"], 2), (["000", "000"], 0), (["11", "11"], 1)])
def test_small_masks(spark, lines, n):
    assert regions.component_sizes(cells(spark, *lines), 4).count() == n
    assert regions.polygons(cells(spark, *lines)).count() == n


def test_sieve_prefers_the_largest_neighbour_and_leaves_small_ones_among_small_ones(spark):
    r = np.array([0, 0, 0, 0, 0, 0])
    c = np.arange(6)
    assert regions.sieve_cells(r, c, np.array([0, 0, 0, 1, 0, 0]), 2, 8).tolist() == [0] * 6
    assert regions.sieve_cells(r, c, np.array([0, 1, 0, 1, 0, 1]), 3, 8).tolist() == [0, 1, 0, 1, 0, 1]


def flooded(cells, connectivity):
    """Components by flooding from each cell in scan order."""
    root = {}
    for start in sorted(cells):
        todo = [start] if start not in root else []
        while todo:
            at = todo.pop()
            if at in root:
                continue
            root[at] = start
            steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not a * b)]
            todo += [n for a, b in steps if (n := (at[0] + a, at[1] + b)) in cells and cells[n] == cells[at]]
    return root


@pytest.mark.parametrize("connectivity", [4, 8])
def test_region_kernels_by_flooding(connectivity):
    rng = np.random.default_rng(connectivity)
    for _ in range(60):
        h, w = rng.integers(1, 14, 2)
        r, c = np.nonzero(rng.random((h, w)) < 0.9)
        v = (rng.random(len(r)) < rng.random()).astype(int)
        order = rng.permutation(len(r))
        r, c, v = r[order] - 3, c[order] + 5, v[order]
        cells = dict(zip(zip(r.tolist(), c.tolist(), strict=True), v.tolist(), strict=True))
        root = flooded(cells, connectivity)
        got = regions.label_cells(r, c, v, connectivity)
        assert [(r[k], c[k]) for k in got] == [root[x, y] for x, y in zip(r.tolist(), c.tolist(), strict=True)]
        size = {k: sum(x == k for x in root.values()) for k in set(root.values())}
        near = {}
        for (a, b), k in root.items():
            for da, db in [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and (connectivity == 8 or not x * y)]:
                other = root.get((a + da, b + db), k)
                if other != k:
                    near.setdefault(k, set()).add(other)
        want = dict(cells)
        for k, others in near.items():
            best = min(others, key=lambda x: (-size[x], x))
            if size[k] < 4 <= size[best]:
                want |= {x: cells[best] for x, y in root.items() if y == k}
        assert regions.sieve_cells(r, c, v, 4, connectivity).tolist() == [want[x, y] for x, y in zip(r.tolist(), c.tolist(), strict=True)]


def test_corners_are_turns():
    ring = regions.trace_rings([e for r, c in ((0, 0), (0, 1), (0, 2), (1, 0)) for e in ((r, c, r, c + 1), (r, c + 1, r + 1, c + 1), (r + 1, c + 1, r + 1, c), (r + 1, c, r, c)) if e not in (((0, 1, 1, 1)), (1, 1, 0, 1), (0, 2, 1, 2), (1, 2, 0, 2), (1, 1, 1, 0), (1, 0, 1, 1))])
    assert ring == [[(0, 0), (0, 3), (1, 3), (1, 1), (2, 1), (2, 0), (0, 0)]]


def test_diagonal_cells_give_two_rings():
    edges = [e for r, c in ((0, 0), (1, 1)) for e in ((r, c, r, c + 1), (r, c + 1, r + 1, c + 1), (r + 1, c + 1, r + 1, c), (r + 1, c, r, c))]
    assert sorted(len(x) for x in regions.trace_rings(edges)) == [5, 5]


def test_polygon_areas_add_up_to_the_mask(spark):
    m = pixels(spark, f"{DATA}/sf0.001").select("tile", "r", "c", (F.col("p") >= 0.5).cast("int").alias("v"))
    assert regions.polygons(m).agg(F.sum("net_area")).first()[0] == m.where("v = 1").count() == regions.component_sizes(m, 4).agg(F.sum("n")).first()[0]
    assert regions.component_sizes(m, 8).count() <= regions.component_sizes(m, 4).count()


@pytest.mark.parametrize("r, c, r0, c0", [(0, 0, 0, 0), (0, 4, 0, 2), (3, 0, 1, 0), (3, 4, 1, 2)])
def test_window_stays_inside(spark, r, c, r0, c0):
    one = spark.range(1).select(patches.clamped_origin(F.lit(r), F.lit(4), 3).alias("a"), patches.clamped_origin(F.lit(c), F.lit(5), 3).alias("b")).first()
    assert (one.a, one.b) == (r0, c0)


def test_near_duplicates_are_strictly_nearer(spark):
    known = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    new = spark.createDataFrame([("a", 0.00009, 0.0), ("b", 0.0001, 0.0), ("c", 0.00011, 0.0), ("d", None, 0.0)], "id string, lat double, lon double")
    assert [r.id for r in labels.near_duplicates(new, known, "id").collect()] == ["a"]
    assert sorted(r.id for r in labels.near_duplicates(new, known, "id", keep_duplicates=False).collect()) == ["b", "c", "d"]


def test_margins_and_threshold_are_inclusive(spark):
    p = spark.createDataFrame([(0.4,), (0.5,), (0.6,), (0.39,), (0.61,)], "p double")
    assert sampling.margin(p).count() == 3


@pytest.mark.parametrize("inside", [3, 5, 7])
def test_round_candidates_fall_back_to_uncertainty(spark, inside):
    p = spark.createDataFrame([(i, 0.5) for i in range(inside)] + [(100 + i, 0.9) for i in range(9)], "k long, p double")
    got = [r.k for r in sampling.round_candidates(p, ["k"]).collect()]
    assert len(got) == 5 and got[:3] == [0, 1, 2] and (100 in got) == (inside < 5)


def test_label_gate_and_balance_of_the_known_counts(spark):
    rows = [(f"i{k}", "agricultural" if k < 10 else "Non-Agricultural") for k in range(58)]
    df = spark.createDataFrame(rows, "id string, label string")
    s = labels.summary(df).first()
    assert (s.agri, s.ok, s.needs_balance) == (10, False, True) and abs(s.ratio - 10 / 58) < 1e-12
    b = labels.balanced(df, "id", 0.20)
    assert b.count() == 50 and b.where("lower(label) = 'agricultural'").count() == 10
    empty = labels.summary(df.limit(0)).first()
    assert (empty.total, empty.ratio, empty.ok) == (0, 0.0, False)


def test_refusal_while_positives_are_few(spark):
    df = spark.createDataFrame([(0, "n"), (1, "Agricultural"), (2, "n"), (3, "n"), (4, "n"), (5, "n"), (6, "n")], "k long, label string").withColumn("g", F.lit(1))
    assert sorted(r.k for r in labels.refused(df, "k", "g").collect()) == [1, 2, 3, 4, 5]


def test_refusals_and_ratios_by_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    rows, want, ratios = [], [], {}
    for g in range(12):
        p = n = 0
        share = rng.random()
        for k in range(int(rng.integers(1, 200))):
            pos = bool(rng.random() < share * (k > 5 * (g % 3)))
            key = k * 12 + g
            rows.append((key, f"g{g}", "Agricultural" if pos else "no"))
            ratios[key] = (sum(r[2] != "no" for r in rows if r[1] == f"g{g}" and r[0] < key), k)
            if pos or (p + n and p / (p + n) >= 0.25):
                want.append(key)
                p, n = p + pos, n + (not pos)
    df = spark.createDataFrame(rows, "k long, g string, label string").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(r.k for r in labels.refused(df, "k", "g").collect()) == sorted(want)
            got = {r.k: r.ag_ratio for r in labels.running_ratio(df, "k", "g").collect()}
            assert all(abs(got[k] - (a / b if b else 0)) < 1e-12 for k, (a, b) in ratios.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert labels.refused(df.limit(0), "k", "g").count() == 0


def test_tile_counts_of_the_regions(spark):
    want = {"Testing": 1, "Boa_Vista": 42, "Brava": 6, "Fogo": 30, "Maio": 20, "Sal": 18, "Santiago": 80, "Santo_Antao": 63, "Sao_Nicolau": 45, "Sao_Vicente": 20}
    assert {r.island: r["count"] for r in grid.tile_grid(grid.islands(spark)).groupBy("island").count().collect()} == want


def test_utm_there_and_back(spark):
    df = spark.createDataFrame([(15.0 + i / 7, -25.3 + i / 5) for i in range(20)], "lat double, lon double")
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    lat, lon = geo.from_utm(F.col("x"), F.col("y"))
    far = df.select("*", x.alias("x"), y.alias("y")).select(F.max(F.abs(lat - F.col("lat"))).alias("a"), F.max(F.abs(lon - F.col("lon"))).alias("b")).first()
    assert far.a < 1e-9 and far.b < 1e-9
    assert abs(df.where("false").count()) == 0


def test_missing_features(spark):
    df = spark.createDataFrame([(1, float("nan"), 5.0, None), (2, 3.0, 5.0, None), (3, None, 5.0, None)], "k int, a double, b double, z double")
    full = stats.impute(df, ["a", "b", "z"], stats.means(df, ["a", "b", "z"])).orderBy("k").collect()
    assert [r.a for r in full] == [3.0, 3.0, 3.0] and full[0].z is None
    s = {r.feature: r for r in stats.summary(df.select("k", "b"), ["b"]).collect()}
    assert s["b"].stdDev == 0
    one = spark.range(1).select(stats.zscore_named(F.lit(7.0), F.lit(5.0), F.lit(0.0)).alias("z"), X.ndvi(F.lit(0.0), F.lit(0.0)).alias("n")).first()
    assert one.z == 2.0 and one.n is None


def test_cloud_bits(spark):
    q = spark.createDataFrame([(0,), (1024,), (2048,), (3072,), (1023,)], "qa int")
    assert [r.ok for r in q.select(composite.clear(F.col("qa")).alias("ok")).collect()] == [True, False, False, False, True]


@pytest.mark.parametrize("h, w, side, full", [(130, 190, 64, 4), (300, 600, 256, 2), (10, 10, 64, 0)])
def test_ragged_patches(spark, h, w, side, full):
    df = spark.createDataFrame([(0, h, w)], "tile int, height long, width long")
    r = patches.patch_counts(df, side, side).first()
    assert r.full == full and r.sliding == full


def test_tolerant_labels(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("image_file,x,y,lat,lon,label\na.tif,1,2,16.6,-24.4,ag\nb.tif,x,2,16.6,-24.4,ag\nc.tif,1,2\nd.tif,3,4,16.6,-24.4,non-ag\n")
    got = files.read_tolerant(spark, str(p), schema.LEGACY_LABEL)
    assert sorted(r.image_file for r in got.collect()) == ["a.tif", "d.tif"]
    assert {r.tile: r.label for r in labels.normalise_legacy(got).collect()} == {"a": "Agricultural", "d": "Non-Agricultural"}


def test_csv_by_name_and_missing_files(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none"), schema.LABEL).count() == 0
    files.create_if_missing(spark, str(tmp_path / "x"), schema.LABEL)
    swapped = spark.createDataFrame([("i", "t", 1.0, 2.0, "Agricultural")], schema.CANDIDATE)
    files.append_by_name(swapped, str(tmp_path / "x"), schema.LABEL)
    assert files.read_csv(spark, str(tmp_path / "x"), schema.LABEL).first().asDict() == {"id": "i", "lat": 1.0, "lon": 2.0, "tile": "t", "label": "Agricultural"}


def test_geotiff_round_trip(spark, tmp_path):
    image = np.arange(2 * 5 * 7, dtype="float32").reshape(2, 5, 7)
    data = geotiff.encode(image, (10.0, 0.0, 200000.0, 0.0, -10.0, 1840000.0))
    back, transform = geotiff.decode(data)
    assert (back == image).all() and transform == (10.0, 0.0, 200000.0, 0.0, -10.0, 1840000.0)
    (tmp_path / "Tile_A.tif").write_bytes(data)
    rows = windows.read_pixels(spark, str(tmp_path), [1]).orderBy("row", "col").collect()
    assert len(rows) == 35 and rows[0].tile == "tile_a" and rows[8].features == [float(image[1, 1, 1])] and rows[0].x == 200005.0
    assert files.list_tiles(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("compression", ["none", "lzw", "deflate"])
@pytest.mark.parametrize(("kind", "predictor"), [("uint8", 1), ("uint8", 2), ("int16", 2), ("uint32", 2), ("float32", 1), ("float32", 3), ("float64", 3)])
def test_geotiff_kinds(compression, kind, predictor):
    rng = np.random.default_rng(1)
    image = (rng.normal(size=(3, 37, 29)) * 1000).astype(kind) if kind[0] == "f" else rng.integers(0, 250, (3, 37, 29)).astype(kind)
    data = geotiff.encode(image, (2.5, 0.0, 10.0, 0.0, -2.5, 90.0), compression, predictor, -9999.0, 32627, ["B2", None, "B4"], strip_rows=16)
    back, transform = geotiff.decode(data)
    assert back.dtype == image.dtype and (back == image).all() and transform == (2.5, 0.0, 10.0, 0.0, -2.5, 90.0)
    assert (geotiff.decode(data, [2, 0])[0] == image[[2, 0]]).all()
    m = geotiff.metadata(data)
    assert (m.width, m.height, m.bands, m.dtype, m.nodata, m.epsg, m.descriptions) == (29, 37, 3, kind, -9999.0, 32627, ["B2", None, "B4"]) and m.bounds == (10.0, 90.0 - 37 * 2.5, 10.0 + 29 * 2.5, 90.0)


def big_tiled(image: np.ndarray, predictor: int) -> bytes:
    """A big-endian BigTIFF of 16 by 16 tiles, all bands of a pixel together."""
    import struct
    import zlib

    bands, h, w = image.shape
    blocks = []
    for r in range(0, h, 16):
        for c in range(0, w, 16):
            block = np.zeros((16, 16, bands), image.dtype)
            part = image[:, r : r + 16, c : c + 16].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            blocks.append(zlib.compress(block.astype(block.dtype.newbyteorder(">")).tobytes()))
    at = 16
    places = []
    for b in blocks:
        places.append(at)
        at += len(b)
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8 * image.itemsize] * bands), (259, 3, [8]), (277, 3, [bands]), (284, 3, [1]), (317, 3, [predictor]), (322, 3, [16]), (323, 3, [16]), (324, 16, places), (325, 16, [len(b) for b in blocks]), (339, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * bands), (34264, 12, [5.0, 0, 0, 100.0, 0, -5.0, 0, 200.0, 0, 0, 0, 0, 0, 0, 0, 1])]
    extra_at, table, extra = at + 8 + 20 * len(entries) + 8, b"", b""
    for tag, kind, values in entries:
        raw = struct.pack(">" + {3: "H", 16: "Q", 12: "d"}[kind] * len(values), *values)
        table += struct.pack(">HHQ", tag, kind, len(values))
        if len(raw) <= 8:
            table += raw.ljust(8, b"\0")
        else:
            table += struct.pack(">Q", extra_at + len(extra))
            extra += raw
    return struct.pack(">2sHHHQ", b"MM", 43, 8, 0, at) + b"".join(blocks) + struct.pack(">Q", len(entries)) + table + struct.pack(">Q", 0) + extra


@pytest.mark.parametrize(("kind", "predictor"), [("uint16", 2), ("float64", 1)])
def test_big_tiled_files_in_the_other_byte_order(kind, predictor):
    image = np.random.default_rng(2).integers(0, 60_000, (2, 21, 35)).astype(kind)
    back, transform = geotiff.decode(big_tiled(image, predictor))
    assert (back == image).all() and transform == (5.0, 0, 100.0, 0, -5.0, 200.0)


def test_files_that_are_not_supported():
    good = geotiff.encode(np.zeros((1, 2, 2), "uint8"), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    for bad in (b"II" + b"\x2b\x01" + good[4:], b"nothing here", good.replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x01\x00", b"\x03\x01\x03\x00\x01\x00\x00\x00\x07\x00"), good.replace(b"\x3d\x01\x03\x00\x01\x00\x00\x00\x01\x00", b"\x3d\x01\x03\x00\x01\x00\x00\x00\x03\x00")):
        assert bad != good
        with pytest.raises(ValueError):
            geotiff.decode(bad)
    assert geotiff.unpack_bits(bytes([2, 65, 66, 67, 254, 68, 128, 0, 69])) == b"ABCDDDE"


@pytest.mark.parametrize("n", [0, 1, 300, 70_000])
def test_lzw_there_and_back(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n).astype("uint8").tobytes(), rng.integers(0, 2, n).astype("uint8").tobytes(), bytes(n)):
        assert geotiff.unpack_lzw(geotiff.pack_lzw(data)) == data


def test_lzw():
    codes, bits = [256, 65, 66, 258, 260, 257], 0
    value = 0
    for c in codes:
        value, bits = value << 9 | c, bits + 9
    pad = -bits % 8
    assert geotiff.unpack_lzw((value << pad).to_bytes((bits + pad) // 8, "big")) == b"ABABABA"


@pytest.mark.parametrize("choice", ["Logistic", "SVM", "ResNet", "RandomForest", "Ensemble"])
def test_models_learn_a_plain_rule(spark, choice, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "d"]).assign(k=range(300), y=(x[:, 0] + x[:, 1] > 0).astype(int)))
    scorer = models.train(choice, df, ["a", "b", "d"], "y", ["k"])
    got = scorer.score(df).toPandas()
    assert ((got.p >= 0.5) == (got.y == 1)).mean() > 0.85
    models.save(scorer, f"file://{tmp_path}/model")
    again = models.load(f"file://{tmp_path}/model").score(df).toPandas()
    assert np.allclose(again.sort_values("k").p, got.sort_values("k").p)
    models.save(scorer, f"file://{tmp_path}/model")  # again, over what is there


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    layers, norms = models.initial_network(3, 4, rng)
    for n in norms:
        n[0] += rng.normal(size=4) / 5
        n[1] += rng.normal(size=4) / 5
    x, y = rng.normal(size=(9, 3)), rng.integers(0, 2, 9)
    grads = models.gradients(layers, norms, x, y)[1]
    learnt = [p for layer in layers for p in layer] + [p for n in norms for p in n[:2]]
    for p, g in zip(learnt, grads, strict=True):
        for at in [tuple(rng.integers(0, p.shape)) for _ in range(3)]:
            p[at] += 1e-6
            up = models.gradients(layers, norms, x, y)[0]
            p[at] -= 2e-6
            down = models.gradients(layers, norms, x, y)[0]
            p[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_patch_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = patchnet.initial(2, 5, 3, rng)
    x, y = rng.normal(size=(4, 2, 5, 5)), np.array([0, 1, 1, 0])
    grads = patchnet.gradients(net, x, y)[1]
    for layer, of in zip(net.layers, grads, strict=True):
        for p, g in zip(layer, of, strict=True):
            assert p.shape == g.shape
            for at in [tuple(rng.integers(0, p.shape)) for _ in range(4)]:
                p[at] += 1e-6
                up = patchnet.gradients(net, x, y)[0]
                p[at] -= 2e-6
                down = patchnet.gradients(net, x, y)[0]
                p[at] += 1e-6
                assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_convolution_by_loops():
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(2, 3, 4, 5)), rng.normal(size=(27, 2)), rng.normal(size=2)
    got, _ = patchnet.convolve(x, w, b)
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    for n, o, r, c in [(0, 0, 0, 0), (1, 1, 3, 4), (0, 1, 2, 2)]:
        assert np.isclose(got[n, o, r, c], b[o] + (padded[n, :, r : r + 3, c : c + 3].ravel() * w[:, o]).sum())


def test_patch_network_learns(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):
        field = k % 2
        for r in range(8):
            for c in range(8):
                rows.append((k, r, c, float(rng.normal() + 3 * field * (r // 2 + c // 2) % 2), float(rng.normal())))
    pixels_ = spark.createDataFrame(rows, "tile int, r long, c long, a double, b double")
    patches_ = patchnet.as_arrays(patches.tumbling(pixels_, 8, 8, 8), ["a", "b"], 8).withColumn("y", F.col("tile") % 2)
    one = patches_.where("tile = 0").first()["values"]
    assert len(one) == 128 and min(one) == 0 and 0.999 < max(one) <= 1
    net = patchnet.fit_rows(patches_, 2, 8, "y", ["tile", "pr", "pc"], width=8, epochs=12, rate=3e-3)
    assert net.history[-1]["loss"] < net.history[0]["loss"] and net.history[-1]["val_accuracy"] > 80
    got = net.score(patches_).select("y", "p").toPandas()
    assert ((got.p > 0.5) == (got.y == 1)).mean() > 0.85


def test_losses_of_epochs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(int)
    scorer = models.fit_network(x[:300], y[:300], ["a", "b", "c"], x[:300].mean(0), x[:300].std(0), validation=(x[300:], y[300:]))
    h = scorer.history
    assert [e["epoch"] for e in h] == list(range(1, 11)) and h[-1]["loss"] < h[0]["loss"] and h[-1]["val_loss"] < h[0]["val_loss"] and h[-1]["val_accuracy"] > 85
    p = scorer.forward(x[300:])
    assert abs(h[-1]["val_loss"] + np.log(np.where(y[300:] == 1, p, 1 - p)).mean()) < 1e-9


def test_settings_are_searched(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(k=range(120), y=(x[:, 0] * x[:, 1] > 0).astype(int)))
    found = models.tune(df, ["a", "b"], "y", ["k"], trees=(5, 10), depths=(1, 6))
    assert found["RandomForest"]["maxDepth"] == 6 and found["RandomForest"]["f1"] > 0.7 and found["SVM"]["f1"] > 0.7 and found["SVM"]["c"] in (0.1, 1.0, 10.0)


def test_fits_take_a_bounded_sample(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assert 300 < len(models.matrix(df, ["a"], "y", ["k"], most=500)[0]) < 700 and len(models.matrix(df, ["a"], "y", ["k"])[0]) == 4000


def test_grid_search_and_unknown_models(spark):
    x = np.array([[0.0], [0.1], [0.2], [1.0], [1.1], [1.2]] * 3)
    y = (x[:, 0] > 0.5).astype(int)
    best, score = models.grid_search(x, y, lambda a, b, cut: lambda z: (z[:, 0] > cut).astype(int), [{"cut": 5.0}, {"cut": 0.5}])
    assert best == {"cut": 0.5} and score == 1.0
    with pytest.raises(ValueError):
        models.train("Other", features(spark, f"{DATA}/sf0.001"), FEATURES, "y", ["vec_id"])


def test_rounds(spark, tmp_path):
    p = pixels(spark, f"{DATA}/sf0.001").withColumn("truth", (F.col("nir") > 25).cast("int")).drop("p", "n")
    truth = p.select("tile", "r", "c", F.when(F.col("truth") == 1, "Agricultural").otherwise("Non-Agricultural").alias("label")).cache()
    seed = sampling.random_per_group(truth, "tile", ["tile", "r", "c"], 6).drop("rank")
    tiles = p.select("tile").distinct().count()
    done, working = rounds.run_loop(spark, str(tmp_path), p, seed, truth, ["nir", "red", "blue"], rounds=2, choice="Logistic")
    assert [d.number for d in done] == [1, 2] and working.count() == 6 * tiles + 5 and rounds.next_round(spark, str(tmp_path)) == 3
    summary = rounds.postprocess(spark.read.parquet(done[-1].predictions)).collect()
    assert len(summary) == tiles and all(0 <= s.pct_agricultural <= 100 for s in summary)


def test_a_round_reads_pixels_and_labels_few_times(spark, tmp_path):
    """The fit's steps read labelled pixels that were looked up once; pixels are read for that and to be scored."""
    p = pixels(spark, f"{DATA}/sf0.001").select("tile", "r", "c", "nir", "red", "blue").cache()
    truth = p.select("tile", "r", "c", F.when(F.col("nir") > 25, "Agricultural").otherwise("Non-Agricultural").alias("label")).cache()
    seed = sampling.random_per_group(truth, "tile", ["tile", "r", "c"], 6).drop("rank").cache()
    read = {"pixels": spark.sparkContext.accumulator(0), "labels": spark.sparkContext.accumulator(0)}

    def counted(rows, name):
        def run(batches):
            for batch in batches:
                read[name].add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    rounds.run_round(spark, f"file://{tmp_path}/alone", 1, counted(p, "pixels"), seed, truth, ["nir", "red", "blue"], "Logistic")
    assert p.count() < read["pixels"].value <= 2 * p.count()
    rounds.run_loop(spark, f"file://{tmp_path}/whole", p, counted(seed, "labels"), truth, ["nir", "red", "blue"], 2, "Logistic")
    assert read["labels"].value == seed.count()


def test_a_loop_that_was_stopped(spark, tmp_path):
    p = pixels(spark, f"{DATA}/sf0.001").withColumn("truth", (F.col("nir") > 25).cast("int")).drop("p", "n").cache()
    truth = p.select("tile", "r", "c", F.when(F.col("truth") == 1, "Agricultural").otherwise("Non-Agricultural").alias("label")).cache()
    seed = sampling.random_per_group(truth, "tile", ["tile", "r", "c"], 6).drop("rank").cache()
    run = lambda name, n, choice="Logistic": rounds.run_loop(spark, f"file://{tmp_path}/{name}", p, seed, truth, ["nir", "red", "blue"], rounds=n, choice=choice)
    one, whole = run("whole", 3)
    run("parts", 1)
    (tmp_path / "parts" / "predictions" / "round=2").mkdir(parents=True)  # a round that broke off
    run("parts", 1)
    two, joined = run("parts", 1)
    assert [r.number for r in two] == [3] and sorted(map(tuple, joined.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, spark.read.parquet(two[-1].predictions).collect())) == sorted(map(tuple, spark.read.parquet(one[-1].predictions).collect()))
    final = rounds.final_model(spark, f"file://{tmp_path}/whole")
    assert np.allclose([r.p for r in final.score(p).orderBy("tile", "r", "c").collect()], [r.p for r in spark.read.parquet(one[-1].predictions).orderBy("tile", "r", "c").collect()])
    assert rounds.final_model(spark, f"file://{tmp_path}/none") is None


def test_split_is_exact(spark):
    df = spark.range(103)
    assert sampling.split(df, ["id"]).where("part = 'train'").count() == 82


def test_kml(spark):
    ring = geo.rectangle(F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(2.0))
    text = spark.range(1).select(geo.document(geo.placemark(F.lit("a"), ring)).alias("t")).first().t
    assert "0.0,1.0,0 2.0,1.0,0 2.0,3.0,0 0.0,3.0,0 0.0,1.0,0" in text and text.endswith("</Document></kml>")
    assert SETTINGS.sieve_pixels == 50


def test_sinks(spark, tmp_path):
    m = cells(spark, "101", "010", tile=3)
    done = sinks.write_masks(m, str(tmp_path / "masks"), 2, 4, (10.0, 0.0, 0.0, 0.0, -10.0, 0.0), 255).collect()
    image, _ = geotiff.decode(open(done[0].path, "rb").read())
    assert done[0].pixels == 3 and image[0].tolist() == [[255, 0, 255, 0], [0, 255, 0, 0]]
    assert not sinks.exists(spark, str(tmp_path / "tiles"))
    sinks.write_tiles(m, str(tmp_path / "tiles"))
    sinks.write_once(m.limit(0), str(tmp_path / "tiles"))
    assert sinks.exists(spark, str(tmp_path / "tiles")) and spark.read.parquet(str(tmp_path / "tiles")).count() == 6
    sinks.write_kml(spark.createDataFrame([("t", "<Placemark/>"), ("t", "<Placemark/>")], "tile string, kml string"), str(tmp_path / "kml"))
    assert spark.read.text(str(tmp_path / "kml")).first().value.count("<Placemark/>") == 2


def test_pictures_of_one_size(spark, tmp_path):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 256, (8, 8, 3)).astype("uint8")
    flat = np.full((5, 9, 3), (10, 20, 30), "uint8")
    for folder in ("images", "masks"):
        (tmp_path / folder).mkdir()
    (tmp_path / "images" / "one.png").write_bytes(images.encode_png(one))
    (tmp_path / "images" / "flat.PNG").write_bytes(images.encode_png(flat))
    (tmp_path / "images" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "masks" / "one.png").write_bytes(images.encode_png((one[:, :, :1] > 127).astype("uint8")))
    same = {r.name: r for r in images.read_images(spark, str(tmp_path / "images"), 8).collect()}
    assert set(same) == {"one", "flat"} and (np.array(same["one"]["values"]).reshape(8, 8, 3) == one).all()
    assert set(map(tuple, np.array(same["flat"]["values"]).reshape(-1, 3).tolist())) == {(10, 20, 30)}
    masks = images.read_images(spark, str(tmp_path / "masks"), 8, "L")
    joined = images.pairs(images.read_images(spark, str(tmp_path / "images"), 8), masks).collect()
    assert [r.name for r in joined] == ["one"] and np.allclose(joined[0].image, one.ravel() / 255) and joined[0]["mask"] == (one[:, :, 0] > 127).astype(int).ravel().tolist()
    # Halving averages about the blocks, and weights add up to 1.
    ramp = np.repeat(np.arange(0, 160, 10, dtype="uint8")[None, :, None], 4, 0)
    half = images.resize(ramp, 4, 8)[0, :, 0].astype(int)
    assert (np.abs(half[1:-1] - (np.arange(1, 7) * 20 + 5)) <= 1).all() and np.allclose(images.coefficients(37, 11).sum(1), 1)
    assert images.grey(np.array([[[255, 255, 255], [255, 0, 0]]], "uint8")).ravel().tolist() == [255, 76]


def test_exports_go_on_where_they_failed(spark, tmp_path):
    calls = []

    def write(name, path):
        calls.append(name)
        if name == "b" and len(calls) < 4:
            raise RuntimeError("no room")
        spark.range(3).write.parquet(path)

    assert exports.export_regions(spark, ["a", "b", "c"], write, str(tmp_path)) == [("a", "COMPLETED"), ("b", "FAILED: RuntimeError"), ("c", "COMPLETED")]
    assert exports.export_regions(spark, ["a", "b", "c"], write, str(tmp_path))[1] == ("b", "COMPLETED") and calls == ["a", "b", "c", "b"]
    states = exports.task_states(spark.createDataFrame([(1, "READY", 1), (1, "FAILED", 3), (2, "RUNNING", 2), (1, "RUNNING", 2)], "task int, state string, ts int"))
    assert {r.task: r.state for r in states.collect()} == {1: "FAILED", 2: "RUNNING"} and not exports.all_done(states).first().done
    assert exports.all_done(states.where("task = 1")).first().done


def test_formula_of_named_operands(spark):
    got = X.with_formula(spark.range(1), "v", "2 * (A - B)", A=F.lit(3), B=F.lit(1))
    assert got.columns == ["id", "v"] and got.first().v == 4.0


def test_rgb_bands():
    assert X.rgb_bands(["B2_s1", "B3_s1", "B4_s1"]) == [3, 2, 1]
    assert X.rgb_bands([None, "x"], strict=False) == [1, 1, 1] and X.rgb_bands([None, "x"]) == [1, 2, 3]


def test_loop_labels_by_hand(spark):
    """Two rounds of the loop against arrays: seeds by hash, a fit, the margin's first cells or the most uncertain, their labels."""
    import hashlib

    import numpy as np

    from acreframe.plans import queries
    from acreframe.sources import adapters

    folder = f"{DATA}/sf0.001"
    pixels = adapters.pixels(spark, folder).select("tile", "r", "c", "nir", "red", "blue").toPandas().sort_values(["tile", "r", "c"], ignore_index=True)
    y = (pixels.nir > 25).astype(int).to_numpy()
    order = [hashlib.md5(f"42|{a}|{b}|{c}".encode()).hexdigest() for a, b, c in zip(pixels.tile, pixels.r, pixels.c, strict=True)]
    known = np.zeros(len(pixels), bool)
    known[pixels.assign(h=order).sort_values("h").groupby("tile").head(6).index] = True
    x = pixels[["nir", "red", "blue"]].to_numpy(float)
    model = models.fit_linear(x[known], y[known], ["nir", "red", "blue"], x[known].mean(0), x[known].std(0))
    z = (x - model.mean) / (np.array(model.std) + 1e-6)
    p = 1 / (1 + np.exp(-(z @ model.weights + model.bias)))
    inside = np.flatnonzero(~known & (p >= 0.4) & (p <= 0.6))
    free = np.flatnonzero(~known)
    added = inside[:5] if len(inside) >= 5 else free[np.argsort(np.abs(p[free] - 0.5), kind="stable")[:5]]
    known[added] = True
    want = {(*k, "Agricultural" if v else "Non-Agricultural") for k, v in zip(pixels[known][["tile", "r", "c"]].itertuples(index=False, name=None), y[known], strict=True)}
    assert {(r.tile, r.r, r.c, r.label) for r in queries.QUERIES["loop_labels"](spark, folder).collect()} == want


def test_forest_scores_by_walking_its_trees(spark, tmp_path):
    """Probabilities from the nodes of the saved trees, one by one."""
    import numpy as np

    from acreframe.sources.adapters import FEATURES, features

    rows = features(spark, f"{DATA}/sf0.001")
    forest = models.fit_forest(rows, FEATURES, "y", numTrees=7, maxDepth=4)
    models.save(forest, f"file://{tmp_path}/forest")
    nodes: dict = {}
    for r in spark.read.parquet(f"file://{tmp_path}/forest/forest/data").collect():
        nodes.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    got = {r.vec_id: r.p for r in forest.score(rows).select("vec_id", "p").collect()}
    for row in rows.collect():
        x = [row[f] if row[f] is not None else m for f, m in zip(FEATURES, forest.mean, strict=True)]
        told = []
        for tree in nodes.values():
            at = tree[0]
            while at.leftChild >= 0:
                at = tree[at.leftChild if x[at.split.featureIndex] <= at.split.leftCategoriesOrThreshold[0] else at.rightChild]
            told.append(at.impurityStats[1] / sum(at.impurityStats))
        assert abs(got[row.vec_id] - np.mean(told)) < 1e-9
