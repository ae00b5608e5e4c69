"""Regions of tiles in blocks against kernels of whole tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreframe.operators import regions


def snake(side):
    """One region that winds through the whole tile, row by row, and its gaps."""
    image = np.zeros((side, side), int)
    image[::2] = 1
    image[1::4, -1] = 1
    image[3::4, 0] = 1
    return image


IMAGES = {
    "noise": lambda: (np.random.default_rng(1).random((40, 33)) < 0.55).astype(int),
    "dense": lambda: (np.random.default_rng(2).random((30, 30)) < 0.8).astype(int),
    "snake": lambda: snake(41),
    "full": lambda: np.ones((25, 25), int),
    "frames": lambda: np.array([[(min(r, c, 28 - r, 28 - c) // 2) % 2 for c in range(29)] for r in range(29)]),
    "checks": lambda: np.indices((20, 20)).sum(0) % 2,
}


def frame(spark, images):
    return spark.createDataFrame([(t, r, c, int(v)) for t, image in images.items() for (r, c), v in np.ndenumerate(image)], "tile string, r long, c long, v int").repartition(5)


@pytest.fixture(scope="module")
def images():
    return {k: f() for k, f in IMAGES.items()}


@pytest.fixture(scope="module")
def masks(spark, images):
    return frame(spark, images)


def whole(image, kernel):
    r, c = (x.ravel() for x in np.indices(image.shape))
    return r, c, kernel(r, c, image.ravel())


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_of_blocks_are_those_of_tiles(masks, images, connectivity):
    got = {(x.tile, x.r, x.c): (x.root_r, x.root_c) for x in regions.components(masks, connectivity, 7).collect()}
    want = {}
    for t, image in images.items():
        r, c, root = whole(image, lambda r, c, v: regions.label_cells(r, c, v, connectivity))
        want |= {(t, int(a), int(b)): (int(r[k]), int(c[k])) for a, b, k in zip(r, c, root, strict=True)}
    assert got == want


@pytest.mark.parametrize(("least", "connectivity"), [(6, 8), (50, 8), (4, 4)])
def test_sieve_of_blocks_is_that_of_tiles(masks, images, least, connectivity):
    got = {(x.tile, x.r, x.c): x.v for x in regions.sieve(masks, least, connectivity, 7).collect()}
    want = {}
    for t, image in images.items():
        r, c, v = whole(image, lambda r, c, v: regions.sieve_cells(r, c, v, least, connectivity))
        want |= {(t, int(a), int(b)): int(x) for a, b, x in zip(r, c, v, strict=True)}
    assert got == want


def plain_rings(image):
    """{first cell of a region: its rings}, from the kernel over the edges of the whole tile."""
    r, c, root = whole(image, lambda r, c, v: regions.label_cells(r, c, v, 4))
    of = {(int(a), int(b)): (int(r[k]), int(c[k])) for a, b, k in zip(r, c, root, strict=True)}
    on = {tuple(map(int, x)) for x in np.argwhere(image)}
    edges = [(r + a, c + b, r + x, c + y) for r, c in on for dr, dc, a, b, x, y in ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0)) if (r + dr, c + dc) not in on]
    out = {}
    for ring in regions.trace_rings(edges):
        (r1, c1), (r2, c2) = ring[0], ring[1]
        dr, dc = np.sign(r2 - r1), np.sign(c2 - c1)
        cell = {(0, 1): (r1, c1), (1, 0): (r1, c1 - 1), (0, -1): (r1 - 1, c1 - 1), (-1, 0): (r1 - 1, c1)}[(dr, dc)]  # on the right of the first edge
        out.setdefault(of[cell], []).append(ring)
    return {k: sorted(rings, key=lambda x: (-regions.area(x), x)) for k, rings in out.items()}


@pytest.mark.parametrize("block", [7, 16, 1024])
def test_rings_of_blocks_are_those_of_tiles(masks, images, block):
    found = regions.polygons(masks, block).collect()
    got = {(x.tile, x.root_r, x.root_c): [[(p.r, p.c) for p in ring] for ring in x.rings] for x in found}
    assert got == {(t, *k): rings for t, image in images.items() for k, rings in plain_rings(image).items()}
    for x in found:
        areas = [regions.area(ring) for ring in got[x.tile, x.root_r, x.root_c]]
        assert (x.outer_area, x.net_area, x.holes) == (areas[0], sum(areas), len(areas) - 1)


def test_a_tile_is_dealt_to_many_tasks(spark):
    big = frame(spark, {"one": np.ones((56, 56), int)}).where("v = 1")
    found = regions.components(big, 4, 7).groupBy("root_r", "root_c").count().collect()
    assert [tuple(x) for x in found] == [(0, 0, 56 * 56)]
    assert [len(x.rings[0]) for x in regions.polygons(big, 7).collect()] == [5]


def test_graph_of_a_long_chain(spark):
    """A chain in mixed order, a star and a ring; rounds grow with the logarithm."""
    order = np.random.default_rng(3).permutation(500).tolist()
    edges = [("a", x, y) for x, y in zip(order, order[1:], strict=False)] + [("b", 0, k) for k in range(1, 200)] + [("c", k, (k + 1) % 50) for k in range(50)] + [("a", 1000, 1001)]
    table = spark.createDataFrame([(t, min(a, b), max(a, b)) for t, a, b in edges], "tile string, a long, b long").distinct()
    got = {(x.tile, x.node): x.root for x in regions.graph_components(table).collect()}
    assert got == {("a", k): 0 for k in range(500)} | {("a", 1000): 1000, ("a", 1001): 1000} | {("b", k): 0 for k in range(200)} | {("c", k): 0 for k in range(50)}


def test_empty_masks(spark, masks):
    none = masks.where("false")
    assert regions.components(none).count() == regions.sieve(none).count() == regions.polygons(none).count() == 0
    assert regions.polygons(masks.withColumn("v", F.lit(0))).count() == 0
