"""One query for each operator or small group of operators, over adapters of the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acreframe.config import SETTINGS
from acreframe.functions import geo, images, stats
from acreframe.functions import indices as X
from acreframe.operators import composite, fits, grid, labels, models, patches, patchnet, quantiles, regions, sampling, warp
from acreframe.plans import exports, rounds
from acreframe.sources import adapters as A
from acreframe.sources import files, sinks, windows
from acreframe.sources import scenes as scene_files

QUERIES = {}
SIDE = 40  # rows and columns of the adapter's tiles
BLOCK = 16  # smaller than a tile, so that regions cross blocks
ORDER = ["tile", "r", "c"]
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]
C = F.col


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def mask(spark: SparkSession, d: str) -> DataFrame:
    return A.pixels(spark, d).select(*ORDER, (C("p") >= SETTINGS.positive_probability).cast("int").alias("v"))


def linear_score(p: DataFrame) -> DataFrame:
    """A fixed model on two bands and NDVI."""
    return p.withColumn("prob", stats.logistic(stats.dot([F.coalesce(X.ndvi(C("nir"), C("red")), F.lit(0.0)), C("nir"), C("red")], [2.0, 0.1, -0.25], -3.0)))


@query
def tile_pct_agri(spark: SparkSession, d: str) -> DataFrame:
    """Percent of agricultural pixels of each tile: index, fixed score, threshold, one aggregation."""
    scored = linear_score(A.pixels(spark, d)).withColumn("v", (C("prob") >= SETTINGS.positive_probability).cast("int"))
    return scored.groupBy("tile").agg(F.count("*").alias("pixels"), F.sum("v").alias("agri"), r6(F.avg("v") * 100, "pct_agricultural"))


@query
def cloud_mask(spark, d):
    return composite.mask_clouds(A.scenes(spark, d)).select("tile", "r", "c", "season", "qa", "B2", "B8")


@query
def seasonal_median(spark, d):
    clear = composite.mask_clouds(composite.select_scenes(A.scenes(spark, d), "2024-01-01", "2024-02-01", 90.0, (0, 7)))
    return composite.seasonal_median(clear).select("tile", "r", "c", "season", *[r6(C(b), b.lower()) for b in SETTINGS.bands])


@query
def spectral_indices(spark, d):
    p = A.pixels(spark, d)
    return p.select(*ORDER, r6(X.ndvi(C("nir"), C("red")), "ndvi"), r6(X.evi(C("nir"), C("red"), C("blue")), "evi"), r6(X.evi2(C("nir"), C("red")), "evi2"), r6(X.nbr(C("nir"), C("swir2")), "nbr"), r6(X.ndmi(C("nir"), C("swir1")), "ndmi"))


@query
def eps_indices(spark, d):
    found = X.eps_indices(C("blue"), C("green"), C("red"), C("nir"), C("swir1"))
    return A.pixels(spark, d).select(*ORDER, *[r6(v, k) for k, v in found.items()])


@query
def stacked_bands(spark, d):
    s = composite.stacked(composite.mask_clouds(A.scenes(spark, d)))
    return s.select(*ORDER, *[r6(C(n), n.lower()) for n in s.columns if n not in ORDER])


@query
def label_summary(spark, d):
    return labels.summary(A.label_points(spark, d)).select("total", "agri", r6(C("ratio"), "ratio"), "ok", "needs_balance")


@query
def legacy_gate(spark, d):
    return labels.legacy_gate(A.label_points(spark, d)).select("total", "agri", r6(C("ratio"), "ratio"), "ratio_ok", "enough")


@query
def balanced_subset(spark, d):
    return labels.balanced(A.label_points(spark, d), "id", SETTINGS.ratio_range[0]).select("id", "label")


@query
def balanced_subset_legacy(spark, d):
    return labels.balanced(A.label_points(spark, d), "id", SETTINGS.legacy_balance_ratio).select("id", "label")


@query
def balanced_negative_sample(spark, d):
    """Positives, and as many negatives."""
    return labels.balanced(A.label_points(spark, d), "id", 0.5).select("id", "label")


@query
def near_duplicates(spark, d):
    p = A.label_points(spark, d)
    return labels.near_duplicates(p.where(C("k") % 2 == 0), p.where(C("k") % 2 == 1), "id").select("id")


@query
def label_binary(spark, d):
    return A.label_points(spark, d).select("id", labels.is_positive(C("label")).cast("int").alias("y"))


@query
def margin_candidates(spark, d):
    return sampling.margin(A.pixels(spark, d)).orderBy(*ORDER).limit(5).select(*ORDER, r6(C("p"), "p"))


@query
def uncertainty_topk(spark, d):
    return sampling.most_uncertain(A.pixels(spark, d), ORDER).select(*ORDER, r6(C("p"), "p"), r6(C("uncertainty"), "uncertainty"))


@query
def round_candidates(spark, d):
    return sampling.round_candidates(A.pixels(spark, d), ORDER).select(*ORDER, r6(C("p"), "p"))


@query
def legacy_uncertainty(spark, d):
    p = A.pixels(spark, d).withColumn("p0", 1 - C("p"))
    return p.where(C("p") > C("p0")).select(*ORDER, r6(1 - F.abs(C("p0") - C("p")), "uncertainty"))


@query
def random_per_tile(spark, d):
    return sampling.random_per_group(A.pixels(spark, d), "tile", ORDER).select(*ORDER, "rank")


@query
def unlabeled_antijoin(spark, d):
    """Pixels that no label stands on."""
    known = A.label_points(spark, d).select((C("k") % 10).alias("tile"), (C("k") % SIDE).alias("r"), ((C("k") * 3) % SIDE).alias("c")).distinct()
    return A.pixels(spark, d).join(known, ORDER, "left_anti").select(*ORDER)


@query
def image_mask_pairs(spark, d):
    """Images with a mask of the same name, the mask's extension by priority."""
    docs = A.read(spark, d, "labels")
    images = docs.select(F.concat(F.lit("Img_"), (C("doc_id") % 100).cast("string")).alias("name")).distinct()
    ext = F.element_at(F.array(*map(F.lit, (".tif", ".png", ".jpeg", ".jpg"))), (C("doc_id") % 4 + 1).cast("int"))
    masks = docs.where(C("doc_id") % 3 == 0).select(F.concat(F.lit("Img_"), (C("doc_id") % 100).cast("string"), ext).alias("file"))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rank = F.when(F.lower("file").endswith(".jpg"), 0).when(F.lower("file").endswith(".png"), 1).when(F.lower("file").endswith(".jpeg"), 2).otherwise(3)
    best = masks.groupBy(stem.alias("name")).agg(F.min_by("file", rank).alias("mask"))
    return images.join(best, "name").select("name", "mask")


@query
def append_labels(spark, d):
    """Round labels, in their own column order, appended by name."""
    p = A.label_points(spark, d)
    master = p.where(C("k") % 2 == 0).select("id", "lat", "lon", "tile", "label")
    return labels.appended(master, p.where(C("k") % 2 == 1).select("id", "tile", "lat", "lon", "label"))


@query
def user_plus_model(spark, d):
    """User labels and model predictions in one table, the missing columns filled."""
    user = A.label_points(spark, d).where(labels.is_positive(C("label"))).select(C("tile"), C("k").alias("x"), F.lit("ag").alias("predicted"), F.lit("user").alias("source"))
    model = A.pixels(spark, d).where("p > 1 - p").select(F.concat(F.lit("tile"), C("tile").cast("string")).alias("tile"), C("c").alias("x"), F.lit("ag").alias("predicted"), F.lit("model").alias("source"), r6(1 - F.abs(1 - 2 * C("p")), "uncertainty"))
    return user.unionByName(model, allowMissingColumns=True)


@query
def append_tiles(spark, d):
    """Predictions of all tiles, less those of tile 0."""
    p = A.pixels(spark, d).select(*ORDER, r6(C("p"), "p"))
    return p.where("tile < 5").unionByName(p.where("tile >= 5")).exceptAll(p.where("tile = 0"))


@query
def latest_round(spark, d):
    """Predictions of the round with the largest number; other folder names are skipped."""
    name = F.when(C("l_linenumber") == 7, "round_temp").otherwise(F.concat(F.lit("round_"), (C("l_linenumber") * 3).cast("string")))
    rows = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", files.round_of(name).alias("round"))
    return sampling.latest_round(rows.where(C("round").isNotNull()))


@query
def split_80_20(spark, d):
    return sampling.split(A.label_points(spark, d).select("id"), ["id"])


@query
def shuffled_order(spark, d):
    """All labels in the order of a seeded shuffle; the first place is the pick of one."""
    return sampling.shuffled(A.label_points(spark, d).select("id"), ["id"]).select("id", C("_h").alias("h"), "place")


def label_boxes(spark, d) -> DataFrame:
    """The bounding box of each tile's labels, as a region of its own."""
    return A.label_points(spark, d).groupBy(C("tile").alias("name")).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


@query
def tile_grid(spark, d):
    """Cells of the regions of interest, and smaller ones of the boxes of labels."""
    g = grid.tile_grid(grid.islands(spark)).unionByName(grid.tile_grid(label_boxes(spark, d), 0.002))
    return g.select("island", "tile_idx", "i", "j", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


def named_tiles(spark) -> DataFrame:
    """Quarters of the smallest region, and a second layer that overlaps them."""
    boxes = [(f"q{i}{j}", -24.400884 + i * 0.003965, 16.644662 + j * 0.003921, -24.400884 + (i + 1) * 0.003965, 16.644662 + (j + 1) * 0.003921) for i in (0, 1) for j in (0, 1)]
    return spark.createDataFrame([*boxes, ("z_over", -24.3975, 16.6465, -24.3955, 16.6505)], "tile string, x0 double, y0 double, x1 double, y1 double")


@query
def tile_of_point(spark, d):
    found = grid.tile_of_point(A.label_points(spark, d).select("id", "lat", "lon"), named_tiles(spark), "id", 0.002)
    return found.select("id", F.coalesce("tile", F.lit("unknown")).alias("tile"))


@query
def bbox_lookup(spark, d):
    """Points inside the first quarter's box, borders included, and their extent."""
    p = A.label_points(spark, d)
    return p.where(C("lon").between(-24.400884, -24.396919) & C("lat").between(16.644662, 16.648583)).agg(F.count("*").alias("n"), *[r6(f(c), n) for f, c, n in ((F.min, "lon", "x0"), (F.min, "lat", "y0"), (F.max, "lon", "x1"), (F.max, "lat", "y1"))])


@query
def affine_roundtrip(spark, d):
    x, y = geo.to_point(C("r"), C("c"), 10.0, 200000.0, -10.0, 1840000.0)
    placed = A.pixels(spark, d).select(*ORDER, x.alias("x"), y.alias("y"))
    row, col = geo.to_cell(C("x"), C("y"), 10.0, 200000.0, -10.0, 1840000.0)
    return placed.select(*ORDER, "x", "y", row.alias("row2"), col.alias("col2"))


@query
def ring_mean(spark, d):
    a, b = geo.ring_mean(C("r"), C("c"), 10.0, 200000.0, -10.0, 1840000.0), geo.ring_mean(C("r"), C("c"), 10.0, 200000.0, -10.0, 1840000.0, parity=False)
    return A.pixels(spark, d).select(*ORDER, r6(a[0], "mean_x"), r6(a[1], "mean_y"), r6(b[0], "center_x"), r6(b[1], "center_y"))


@query
def utm_forward(spark, d):
    x, y = geo.to_utm(C("lat"), C("lon"))
    return A.label_points(spark, d).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query
def utm_roundtrip(spark, d):
    """Points whose way to UTM and back moves them by less than 1e-9 degrees."""
    x, y = geo.to_utm(C("lat"), C("lon"))
    placed = A.label_points(spark, d).select("id", "lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = geo.from_utm(C("x"), C("y"))
    return placed.select("id", ((F.abs(lat - C("lat")) < 1e-9) & (F.abs(lon - C("lon")) < 1e-9)).alias("close"))


def placed_labels(spark, d) -> DataFrame:
    """Labels with a cell each: latitudes and longitudes over a grid of 2e-4 degrees."""
    return A.label_points(spark, d).select("id", "k", (C("k") % 10).alias("tile"), F.floor((16.652504 - C("lat")) / 0.0002).cast("bigint").alias("r"), F.floor((C("lon") + 24.400884) / 0.0002).cast("bigint").alias("c"), "label")


@query
def pixel_at_label(spark, d):
    p = A.pixels(spark, d).select(*ORDER, r6(C("nir"), "nir"), r6(C("red"), "red"))
    return placed_labels(spark, d).join(p, ORDER, "left").select("id", "tile", "r", "c", "nir", "red")


@query
def label_features(spark, d):
    """Features of labels whose pixel exists, as one array in band order."""
    p = A.pixels(spark, d).select(*ORDER, F.array(*[F.round(C(b), 6) for b in BANDS]).alias("features"))
    y = labels.is_positive(C("label")).cast("int")
    return placed_labels(spark, d).join(p, ORDER).select("id", y.alias("y"), *[C("features")[i].alias(f"f{i}") for i in range(6)])


@query
def label_tile_rejects(spark, d):
    """Labels of tiles that are not known: no other tile stands in for theirs."""
    tiles = spark.createDataFrame([(f"TILE{i}",) for i in range(7)], "tile string")
    return labels.with_tile(A.label_points(spark, d), tiles)[1].select("id", "tile")


@query
def window3x3_features(spark, d):
    points = placed_labels(spark, d).select(C("id").alias("key"), "tile", "r", "c")
    found = patches.window_features(points, A.pixels(spark, d).select(*ORDER, F.round("nir", 6).alias("nir"), F.round("red", 6).alias("red")), ["nir", "red"], SIDE, SIDE)
    return found.select("key", F.size("features").alias("n"), r6(F.aggregate("features", F.lit(0.0), lambda a, b: a + b), "total"), C("features")[0].alias("first"), C("features")[17].alias("last"))


@query
def window_reads(spark, d):
    """The same windows from files: only the strips that windows meet are read."""
    folder = files.shared_folder(spark, "strips")
    sinks.write_rasters(A.pixels(spark, d), ["nir", "red"], folder, SIDE, SIDE, TRANSFORM, strip_rows=4).agg(F.sum("pixels")).first()
    points = placed_labels(spark, d).select(C("id").alias("key"), F.concat(F.lit("tile_"), C("tile").cast("string")).alias("tile"), "r", "c")
    found = windows.read_windows(points, files.kept(windows.geometry(spark, folder), "geometry"), [0, 1])
    values = F.transform("features", lambda v: F.round(v, 6))
    return found.select("key", F.size("features").alias("n"), r6(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), "total"), values[0].alias("first"), values[17].alias("last"))


@query
def centred_patch(spark, d):
    """Origin of the 16-cell patch around each label, moved to stay inside."""
    return placed_labels(spark, d).select("id", patches.clamped_origin(C("r"), F.lit(SIDE), 16).alias("r0"), patches.clamped_origin(C("c"), F.lit(SIDE), 16).alias("c0"))


@query
def patch_minmax(spark, d):
    """Min-max scaled NIR of full patches of 16 cells: sums, as all cells are too many to list."""
    t = patches.tumbling(A.pixels(spark, d), 16, SIDE, SIDE)
    w = Window.partitionBy("tile", "pr", "pc")
    scaled = t.withColumn("z", stats.min_max(C("nir"), F.min("nir").over(w), F.max("nir").over(w)))
    return scaled.groupBy("tile", "pr", "pc").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("total"), F.round(F.max("z"), 6).alias("top"))


@query
def patch_counts(spark, d):
    sizes = A.read(spark, d, "part").select(C("p_partkey").alias("tile"), (C("p_size") * 20).cast("bigint").alias("height"), ((C("p_partkey") * 7) % 900).alias("width"))
    return patches.patch_counts(sizes, SETTINGS.patch, SETTINGS.patch)


@query
def patch_inference(spark, d):
    """A score of each full patch and its class, by the strict rule."""
    t = patches.tumbling(A.pixels(spark, d), 8, SIDE, SIDE).groupBy("tile", "pr", "pc").agg(F.avg("p").alias("p"))
    return t.select("tile", "pr", "pc", F.round("p", 9).alias("p"), F.when(F.round("p", 9) > F.round(1 - C("p"), 9), "ag").otherwise("non-ag").alias("predicted"))


@query
def patch_to_pixel_mask(spark, d):
    """Patch classes spread back to pixels as 255 or 0, keyed by the patch, never by position."""
    t = patches.tumbling(A.pixels(spark, d), 8, SIDE, SIDE)
    scored = t.groupBy("tile", "pr", "pc").agg(F.avg("p").alias("patch_p"))
    return t.join(scored, ["tile", "pr", "pc"]).select(*ORDER, F.when(F.round("patch_p", 9) >= 0.5, 255).otherwise(0).alias("mask"))


@query
def per_band_minmax(spark, d):
    """Each band scaled by its tile's extremes."""
    p = A.pixels(spark, d)
    ends = p.groupBy("tile").agg(*[f(b).alias(f"{b}_{n}") for b in ("nir", "red") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return p.join(ends, "tile").select(*ORDER, *[r6(stats.min_max(C(b), C(f"{b}_lo"), C(f"{b}_hi")), b) for b in ("nir", "red")])


@query
def rgb_stretch(spark, d):
    p = A.pixels(spark, d)
    ends = p.groupBy("tile").agg(F.min(F.least("red", "green", "blue")).alias("lo"), F.max(F.greatest("red", "green", "blue")).alias("hi"))
    return p.join(ends, "tile").select(*ORDER, *[X.stretch(C(b), C("lo"), C("hi")).alias(b) for b in ("red", "green", "blue")])


@query
def red_overlay(spark, d):
    """Red where the mask is set, the picture elsewhere."""
    p = A.pixels(spark, d)
    on = C("p") >= 0.5
    return p.select(*ORDER, F.when(on, 255).otherwise(F.floor("red").cast("int")).alias("red"), F.when(on, 0).otherwise(F.floor("green").cast("int")).alias("green"), F.when(on, 0).otherwise(F.floor("blue").cast("int")).alias("blue"))


@query
def mask255(spark, d):
    return mask(spark, d).where("v = 1").select(*ORDER, F.when(C("v") == 1, 255).otherwise(0).alias("mask"))


@query
def augment_patch(spark, d):
    cells = patches.tumbling(A.pixels(spark, d), 8, SIDE, SIDE).select(*ORDER, "pr", "pc", F.round("p", 6).alias("p"))
    local = cells.withColumns({"r": C("r") - C("pr"), "c": C("c") - C("pc")})
    h = lambda part: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SETTINGS.seed), C("tile").cast("string"), C("pr").cast("string"), C("pc").cast("string"), F.lit(part))), 1, 4), 16, 10).cast("int")
    return patches.augmented(local, 8, h("h") % 2 == 1, h("v") % 2 == 1, h("t") % 4).select("tile", "pr", "pc", "r", "c", "r2", "c2", "p")


@query
def terrain_slope_aspect(spark, d):
    t = grid.slope_aspect(A.pixels(spark, d), "nir")
    full = t.where("slope is not null")
    return full.select(*ORDER, F.round("slope", 5).alias("slope"), F.round(F.when(C("slope") > 1e-9, C("aspect")), 5).alias("aspect"))


@query
def components4(spark, d):
    return regions.components(mask(spark, d).where("v = 1"), 4).select(*ORDER, (C("root_r") * SIDE + C("root_c")).alias("root"))


@query
def components8(spark, d):
    return regions.component_sizes(mask(spark, d), 8, BLOCK).select("tile", (C("root_r") * SIDE + C("root_c")).alias("root"), "n")


@query
def field_sizes(spark, d):
    sizes = regions.component_sizes(mask(spark, d), 4)
    return sizes.groupBy("tile").agg(F.count("*").alias("fields"), F.sum("n").alias("pixels"), F.max("n").alias("largest"), r6(F.avg("n"), "mean"))


@query
def sieve50(spark, d):
    """Percent of agricultural pixels of each tile after the sieve."""
    return regions.sieve(mask(spark, d)).groupBy("tile").agg(F.count("*").alias("pixels"), F.sum("v").alias("agri"), r6(F.avg("v") * 100, "pct_agricultural"))


@query
def classify_and_sieve(spark, d):
    scored = linear_score(A.pixels(spark, d)).select(*ORDER, (C("prob") >= 0.5).cast("int").alias("v"))
    return regions.sieve(scored, 20).groupBy("tile").agg(F.sum("v").alias("agri"), r6(F.avg("v") * 100, "pct_agricultural"))


@query
def components_in_blocks(spark, d):
    """Components of tiles that are cut into smaller blocks, joined across their borders."""
    return regions.components(mask(spark, d).where("v = 1"), 4, BLOCK).select(*ORDER, (C("root_r") * SIDE + C("root_c")).alias("root"))


@query
def sieve_in_blocks(spark, d):
    """The sieve over regions that cross blocks."""
    return regions.sieve(mask(spark, d), block=BLOCK).groupBy("tile").agg(F.count("*").alias("pixels"), F.sum("v").alias("agri"), r6(F.avg("v") * 100, "pct_agricultural"))


@query
def rings_in_blocks(spark, d):
    """Outer rings from chains of edges that cross blocks."""
    p = regions.polygons(mask(spark, d), BLOCK)
    return p.select("tile", "root_r", "root_c", F.size(C("rings")[0]).alias("corners"), F.round("outer_area", 1).alias("outer_area"), "holes", F.lit("EPSG:32627").alias("crs"))


@query
def adjacency_pairs(spark, d):
    return regions.adjacency(mask(spark, d))


@query
def boundary_edges(spark, d):
    e = regions.boundary_edges(mask(spark, d))
    return e.select("tile", *[C(c).cast("bigint").alias(c) for c in ("r1", "c1", "r2", "c2")])


@query
def polygon_count(spark, d):
    p = regions.polygons(mask(spark, d))
    return p.groupBy("tile").agg(F.count("*").alias("polygons"), F.sum("net_area").cast("bigint").alias("pixels"))


@query
def polygons_kml(spark, d):
    """A KML document for each tile, a placemark for each polygon's outer ring, in WGS84."""
    lat, lon = geo.from_utm(C("x"), C("y"))
    p = regions.polygons(mask(spark, d)).select("tile", "root_r", "root_c", F.posexplode(C("rings")[0]).alias("k", "p"))
    placed = p.select("tile", "root_r", "root_c", "k", (200000.0 + C("p.c") * 10.0).alias("x"), (1840000.0 - C("p.r") * 10.0).alias("y"))
    ring = placed.withColumns({"lat": F.round(lat, 7), "lon": F.round(lon, 7)}).groupBy("tile", "root_r", "root_c").agg(F.sort_array(F.collect_list(F.struct("k", C("lon").alias("x"), C("lat").alias("y")))).alias("ring"))
    marks = ring.select("tile", F.struct("root_r", "root_c", geo.placemark(F.concat_ws("_", F.lit("field"), "root_r", "root_c"), C("ring")).alias("kml")).alias("m"))
    return marks.groupBy("tile").agg(F.count("*").alias("placemarks"), geo.document(F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["kml"]), "")).alias("kml"))


@query
def exterior_ring(spark, d):
    """Corners of each polygon's outer ring; holes stay with the polygon but are not listed."""
    p = regions.polygons(mask(spark, d))
    return p.select("tile", "root_r", "root_c", F.size(C("rings")[0]).alias("corners"), F.round("outer_area", 1).alias("outer_area"), "holes", F.lit("EPSG:32627").alias("crs"))


@query
def candidate_kml(spark, d):
    """KML rings of candidate pixels, as corners in whole metres."""
    c = sampling.random_per_group(A.pixels(spark, d), "tile", ORDER, 2)
    x, y = geo.to_point(C("r"), C("c"), 10, 200000, -10, 1840000, 0)
    ring = geo.rectangle((x + 5).cast("bigint"), (y - 5).cast("bigint"), F.lit(10).cast("bigint"), F.lit(10).cast("bigint"))
    return c.select(*ORDER, geo.coordinates(F.transform(ring, lambda p: F.struct(p["x"].cast("bigint").alias("x"), p["y"].cast("bigint").alias("y")))).alias("ring"))


@query
def patch_footprint(spark, d):
    """Rectangle of three pixels a side around each label, by the tile's pixel size or a default."""
    size = F.when(C("k") % 10 == 9, F.lit(None).cast("double")).otherwise((C("k") % 10 + 1) / 1000.0)
    side = F.coalesce(3 * F.abs(size), F.lit(0.001))
    p = A.label_points(spark, d)
    return p.select("id", r6(C("lon") - side / 2, "x0"), r6(C("lat") - side / 2, "y0"), r6(C("lon") + side / 2, "x1"), r6(C("lat") + side / 2, "y1"))


@query
def tile_clip(spark, d):
    """Pixels whose centre lies in a rectangle, snapped to a 10 m grid."""
    x, y = geo.to_point(C("r"), C("c"), 7.5, 200000.0, -7.5, 1840000.0)
    p = A.pixels(spark, d).select(*ORDER, x.alias("x"), y.alias("y"))
    return p.where(C("x").between(200050.0, 200200.0) & C("y").between(1839750.0, 1839950.0)).select(*ORDER, F.floor((C("x") - 200000) / 10).alias("gx"), F.floor((1840000 - C("y")) / 10).alias("gy"))


def degree_tiles(spark, d) -> DataFrame:
    """The adapter's tiles as rasters in degrees, of about 11 m a cell, side by side."""
    tiles = A.tiles(spark, d)
    return tiles.select("tile", (C("tile") % 200 * 0.0041 - 24.4).alias("lon0"), (F.floor(C("tile") / 200) * 0.0041 + 16.65).alias("lat0"), F.lit(0.0001).alias("step"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))


@query
def warp_nearest(spark, d):
    """Rasters in degrees on the 10 m grid of the zone, each cell with the value of its nearest source cell."""
    p = A.pixels(spark, d).select(*ORDER, "nir", "red")
    return warp.nearest(p, degree_tiles(spark, d), ["nir", "red"]).select("tile", "gx", "gy", "r", "c", r6(C("nir"), "nir"), r6(C("red"), "red"))


@query
def warp_bilinear(spark, d):
    """The same by the four source cells around each centre."""
    p = A.pixels(spark, d).select(*ORDER, "nir", "red")
    return warp.bilinear(p, degree_tiles(spark, d), ["nir", "red"]).select("tile", "gx", "gy", F.round("nir", 4).alias("nir"), F.round("red", 4).alias("red"))


@query
def tile_extent(spark, d):
    return A.pixels(spark, d).groupBy("tile").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("*").alias("pixels"))


@query
def feature_stats(spark, d):
    f = A.features(spark, d)
    s = stats.summary(stats.impute(f, A.FEATURES, stats.means(f, A.FEATURES)), A.FEATURES)
    return s.select("feature", *[r6(C(c), c) for c in ("mean", "low", "high", "variance")])


@query
def impute_zscore(spark, d):
    f = A.features(spark, d)
    known = stats.means(f, A.FEATURES)
    full = stats.impute(f, A.FEATURES, known)
    s = full.agg(*[g(c).alias(f"{c}_{n}") for c in ("f0", "f1", "f3") for g, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    return full.crossJoin(F.broadcast(s)).select("vec_id", *[F.round(stats.zscore(C(c), C(f"{c}_m"), C(f"{c}_s")), 5).alias(c) for c in ("f0", "f1", "f3")])


@query
def standardise_pop(spark, d):
    """Standardised by the population deviation, not the sample's."""
    f = A.features(spark, d)
    s = f.agg(F.avg("f1").alias("m"), F.stddev_pop("f1").alias("s"))
    return f.crossJoin(F.broadcast(s)).select("vec_id", F.round((C("f1") - C("m")) / C("s"), 5).alias("z"))


@query
def zscore_named(spark, d):
    """Features in long form joined to stored normalizers by name; a deviation of 0 counts as 1."""
    norms = spark.createDataFrame([("f1", 0.01, 0.1), ("f2", 0.0, 0.0), ("f4", -0.02, 0.125)], "feature string, mean double, stdDev double")
    f = A.features(spark, d)
    long = f.select("vec_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), C(c).alias("x")) for c in ("f1", "f2", "f4")])).alias("s")).select("vec_id", "s.*")
    return long.join(F.broadcast(norms), "feature").select("vec_id", "feature", r6(stats.zscore_named(C("x"), C("mean"), C("stdDev")), "z"))


@query
def auto_tune_params(spark, d):
    """Percentiles of field sizes (10, cut to a whole number) and of uncertainty (40 and 60)."""
    sizes = files.kept(regions.component_sizes(mask(spark, d), 4).select("n"), "sizes")
    unsure = files.kept(A.pixels(spark, d).select(F.abs(C("p") - 0.5).alias("u")), "uncertainty")
    least = quantiles.percentiles(sizes, C("n"), [0.1])[0]
    low, high = quantiles.percentiles(unsure, C("u"), [0.4, 0.6])
    found = spark.createDataFrame([(None if least is None else int(least), low, high)], "min_field int, uncertainty_low double, uncertainty_high double")
    return found.select("min_field", r6(C("uncertainty_low"), "uncertainty_low"), r6(C("uncertainty_high"), "uncertainty_high"))


@query
def softmax_score(spark, d):
    f = A.features(spark, d)
    a, b = C("f1") + 0.5 * C("f2"), 2 * C("f4") - C("f5")
    p = stats.softmax_two(a, b)
    return f.select("vec_id", F.round(p, 6).alias("p1"), (b > a).cast("int").alias("class"), r6(F.greatest(C("f6"), F.lit(0.0)), "relu"))


def fixed_network() -> models.NetworkScorer:
    """A network whose numbers are whole-number arithmetic, so that any engine can write them down."""

    def weights(layer: int, rows: int, cols: int) -> list:
        return [[((i * 37 + j * 101 + layer * 53 + 11) % 199 - 99) / (99.0 * rows**0.5) for j in range(cols)] for i in range(rows)]

    layers = [[weights(k, a, b), [((j * 29 + k * 7) % 13 - 6) / 60.0 for j in range(b)]] for k, (a, b) in enumerate(((8, 64), (64, 64), (64, 64), (64, 2)))]
    norms = [[[1 + ((j * 5 + k) % 7 - 3) / 20.0 for j in range(64)], [((j * 3 + k) % 5 - 2) / 10.0 for j in range(64)], [((j * 11 + k) % 9 - 4) / 50.0 for j in range(64)], [0.5 + (j * 13 + k) % 8 / 10.0 for j in range(64)]] for k in range(3)]
    return models.NetworkScorer(A.FEATURES, [0.0] * 8, [0.125] * 8, layers, norms)


@query
def resnet_forward(spark, d):
    return fixed_network().score(A.features(spark, d)).select("vec_id", F.round("p", 6).alias("p"))


@query
def rf_score(spark, d):
    f = A.features(spark, d)
    return models.train("RandomForest", f.where("vec_id % 5 <> 0"), A.FEATURES, "y", ["vec_id"]).score(f).select("vec_id", F.round("p", 6).alias("p"))


@query
def svm_score(spark, d):
    f = A.features(spark, d)
    return models.train("SVM", f, A.FEATURES, "y", ["vec_id"]).score(f).select("vec_id", F.round("p", 6).alias("p"))


@query
def ensemble_score(spark, d):
    f = A.features(spark, d)
    both = models.Ensemble([models.train(c, f, A.FEATURES, "y", ["vec_id"]) for c in ("Logistic", "ResNet")])
    return both.score(f).select("vec_id", F.round("p", 6).alias("p"))


@query
def accuracy_f1(spark, d):
    """Accuracy in percent and F1 of the positive class of thresholded probabilities against labels of pixels."""
    p = A.pixels(spark, d).select((C("p") >= 0.5).cast("int").alias("y"), (C("nir") >= 25).cast("int").alias("q"))
    hit, total = F.count_if((C("y") == 1) & (C("q") == 1)), F.sum(C("y") + C("q"))
    return p.agg(r6(100 * F.avg((C("y") == C("q")).cast("double")), "accuracy"), r6(F.coalesce(F.try_divide(2.0 * hit, total), F.lit(0.0)), "f1"))


@query
def ndvi_bounds_by_month(spark, d):
    """Month bounds of order dates; timestamps from milliseconds or text, unknown ones have their own bound."""
    o = A.read(spark, d, "orders").select("o_orderkey", C("o_orderdate").cast("timestamp").alias("o_orderdate"))
    ts = F.when(C("o_orderkey") % 11 == 0, F.lit(None).cast("timestamp")).when(C("o_orderkey") % 2 == 0, F.timestamp_millis(F.unix_millis("o_orderdate"))).otherwise(F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")))
    return o.select("o_orderkey", X.ndvi_floor(ts).cast("double").alias("low"), F.lit(0.85).cast("double").alias("high"))


@query
def candidate_ids(spark, d):
    p = sampling.random_per_group(A.pixels(spark, d), "tile", ORDER)
    return p.select(*ORDER, F.concat_ws("_", F.lit("AL_3"), F.substring(labels.hash_order(*map(C, ORDER)), 1, 12)).alias("id"))


@query
def pending_candidates(spark, d):
    """The first 10 candidates without a label."""
    p = A.label_points(spark, d).withColumn("label", F.when(C("k") % 3 == 0, F.lit("  ")).otherwise(C("label")))
    return p.where(F.trim("label") == "").orderBy("k").limit(10).select("id", "tile")


def candidate_lists(spark, d) -> list:
    p = A.label_points(spark, d).withColumns({"lat": 16.6 + C("k") % 50 * 4 / 1e7, "lon": -24.4 + C("k") % 20 * 4 / 1e7})
    return [("rand", p.where("k % 3 <> 0")), ("marg", p.where("k % 2 = 0"))]


@query
def candidate_union(spark, d):
    return sampling.union_candidates(candidate_lists(spark, d)).select("id", "tile", r6(C("lat"), "lat"), r6(C("lon"), "lon"), "label")


@query
def hybrid_candidates(spark, d):
    """Random pixels of each tile and margin pixels in hash order, in one list."""
    p = A.pixels(spark, d)
    place = lambda x: x.select("tile", (C("r") / 100.0).alias("lat"), (C("c") / 100.0).alias("lon"))
    margin = sampling.random_per_group(sampling.margin(p), "tile", ORDER, 3)
    return sampling.union_candidates([("rand", place(sampling.random_per_group(p, "tile", ORDER))), ("marg", place(margin))]).select("id", "tile", r6(C("lat"), "lat"), r6(C("lon"), "lon"))


@query
def roi_points(spark, d):
    """Random points in the regions of interest and in the boxes of labels."""
    return sampling.roi_points(grid.islands(spark).unionByName(label_boxes(spark, d)), 50).select("name", "k", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query
def random_pixels(spark, d):
    tiles = A.pixels(spark, d).groupBy("tile").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return sampling.random_cells(tiles, 20)


@query
def running_ag_ratio(spark, d):
    return labels.running_ratio(A.label_points(spark, d), "k", "tile").select("id", r6(C("ag_ratio"), "ag_ratio"))


@query
def label_refusal(spark, d):
    return labels.refused(A.label_points(spark, d), "k", "tile")


@query
def valid_rows(spark, d):
    """Lines of six fields whose x and y are whole numbers, of image files by suffix."""
    k = C("doc_id")
    line = F.concat_ws(",", F.concat(F.lit("T"), k.cast("string"), F.when(k % 3 == 0, ".TIF").otherwise(".txt")), F.when(k % 5 == 0, "x").otherwise(k.cast("string")), (k * 2).cast("string"), F.lit("16.6"), F.when(k % 7 == 0, "-24.4,spare").otherwise("-24.4"), F.lit("ag"))
    parts = A.read(spark, d, "labels").select(F.split(line, ",").alias("p")).where(F.size("p") == 6)
    raw = parts.select(*[C("p")[i].alias(n) for i, n in enumerate(("image_file", "x", "y", "lat", "lon", "label"))])
    from acreframe.schema import LEGACY_LABEL

    return files.valid_rows(raw, LEGACY_LABEL).where(F.lower("image_file").rlike(r"\.(tif|png|jpe?g)$")).select("image_file", C("x").cast("bigint").alias("x"), C("y").cast("bigint").alias("y"))


@query
def block_mean(spark, d):
    """Means of blocks of 4 by 4 cells, the display's reduction."""
    return A.pixels(spark, d).groupBy("tile", F.floor(C("r") / 4).alias("br"), F.floor(C("c") / 4).alias("bc")).agg(F.round(F.avg("nir"), 9).alias("nir"))


@query
def nearest_resize(spark, d):
    """A 10 by 10 mask of the block means put back on 40 by 40 cells by the nearest source cell."""
    small = A.pixels(spark, d).groupBy("tile", F.floor(C("r") / 4).alias("br"), F.floor(C("c") / 4).alias("bc")).agg((F.round(F.avg("p"), 9) >= 0.5).cast("int").alias("v"))
    cells = spark.range(SIDE).select(C("id").alias("r")).crossJoin(spark.range(SIDE).select(C("id").alias("c")))  # a fixed grid
    at = cells.withColumns({"br": F.floor((C("r") + 0.5) * 10 / SIDE), "bc": F.floor((C("c") + 0.5) * 10 / SIDE)})
    return small.join(F.broadcast(at), ["br", "bc"]).select(*ORDER, "v")


@query
def postprocess_summary(spark, d):
    """The summary of the latest model: score, threshold, percent by tile, in order of the tile's name."""
    scored = fixed_linear().score(A.pixels(spark, d))
    s = scored.groupBy(F.concat(F.lit("tile"), C("tile").cast("string")).alias("tile")).agg(r6(F.avg((C("p") >= 0.5).cast("int")) * 100, "pct_agricultural"))
    return s.select("tile", F.bround("pct_agricultural", 2).alias("pct_agricultural"))


@query
def stack_with_terrain(spark, d):
    """Stacked seasonal bands joined by pixel to elevation, slope and aspect: 36 bands."""
    terrain = A.pixels(spark, d)
    slopes = grid.slope_aspect(terrain, "nir")
    full = composite.stacked(composite.mask_clouds(A.scenes(spark, d))).join(terrain.select(*ORDER, C("nir").alias("elevation")), ORDER).join(slopes, ORDER, "left")
    flat = F.when(C("slope") > 1e-9, C("aspect"))
    return full.select(*ORDER, *[r6(C(n), n.lower()) for n in ("B2_s1", "B8_s2", "NDVI_s3", "NBR_s1")], r6(C("elevation"), "elevation"), F.round("slope", 5).alias("slope"), F.round(flat, 5).alias("aspect"), F.lit(len(full.columns) - 3).alias("bands"))


@query
def scene_bounds(spark, d):
    """Scenes whose footprint meets a box and whose time lies in a half-open season."""
    s = A.scenes(spark, d).withColumns({"x0": C("r") * 1.0, "y0": C("c") * 1.0, "x1": C("r") + 1.0, "y1": C("c") + 1.0})
    return composite.intersecting(composite.select_scenes(s, "2024-01-11", "2024-01-21", 60.0), 1.5, 0.5, 2.0, 1.0).groupBy("tile", "r", "c").agg(F.count("*").alias("n"))


@query
def scene_collection(spark, d):
    """The same scenes and season by season counts from a collection of files: time, cloud and place go to the source, which skips files."""
    folder = files.shared_folder(spark, "scenes")
    scene_files.write_scenes(A.scenes(spark, d), folder)
    found = composite.select_scenes(scene_files.read_scenes(spark, folder), "2024-01-11", "2024-01-21", 60.0, (3, 40))
    return found.groupBy("tile", "r", "c", "season").agg(F.count("*").alias("n"), F.sum("B2").alias("b2"), F.max("qa").alias("qa"))


@query
def expression_dsl(spark, d):
    """An index as a formula with named operands."""
    p = A.pixels(spark, d).select(*ORDER, C("nir").alias("band_a"), C("red").alias("band_b"))
    return X.with_formula(p, "evi2", "round(2.5 * (NIR - RED) / (NIR + 2.4 * RED + 1), 6)", NIR=C("band_a"), RED=C("band_b")).select(*ORDER, "evi2")


@query
def overlay_points(spark, d):
    """Pixels in circles of two cells around candidates."""
    p = A.pixels(spark, d)
    return sinks.overlay(p.select(*ORDER), sampling.random_per_group(p, "tile", ORDER, 2), 2).groupBy("tile").agg(F.count_if("marked").alias("marked"), F.count("*").alias("pixels"))


@query
def answered_candidates(spark, d):
    """Pending candidates take the label of the answers; others keep theirs."""
    p = A.label_points(spark, d)
    candidates = p.select("id", "tile", "lat", "lon", F.when(C("k") % 2 == 0, "").otherwise("Agricultural").alias("label"))
    return labels.answered(candidates, p.where("k % 3 <> 0").select("id", "label")).select("id", "tile", "label")


@query
def label_batch(spark, d):
    """A batch of labels added to the others, less near duplicates."""
    p = A.label_points(spark, d).select("id", "lat", "lon", "tile", "label", "k")
    return labels.add_batch(p.where("k % 2 = 1"), p.where("k % 2 = 0")).select("id", "label")


@query
def legacy_candidates(spark, d):
    """Random cells of each tile that are not labelled, with the uncertainty of no model, 1."""
    tiles = A.pixels(spark, d).groupBy("tile").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    known = A.label_points(spark, d).select((C("k") % 10).alias("tile"), (C("k") % SIDE).alias("r"), ((C("k") * 3) % SIDE).alias("c")).distinct()
    return sampling.random_cells(tiles, 40).join(known, ORDER, "left_anti").select(*ORDER, "k", F.lit(1.0).alias("uncertainty"))


@query
def check_results_report(spark, d):
    """Counts by source and the model's share of agricultural patches among all patches."""
    t = patches.tumbling(A.pixels(spark, d), 8, SIDE, SIDE).groupBy("tile", "pr", "pc").agg(F.avg("p").alias("p"))
    ag = F.count_if(F.round("p", 9) > F.round(1 - C("p"), 9))
    model = t.agg(F.count("*").alias("rows"), ag.alias("ag")).select(F.lit("model").alias("source"), "rows", "ag", r6(F.try_divide(C("ag").cast("double"), C("rows")), "ratio"))
    user = labels.summary(A.label_points(spark, d)).select(F.lit("user").alias("source"), C("total").alias("rows"), C("agri").alias("ag"), r6(C("ratio"), "ratio"))
    return user.unionByName(model)


def fixed_linear() -> models.LinearScorer:
    return models.LinearScorer(["nir", "red"], [25.0, 4.0], [10.0, 2.0], [1.0, -0.5], 0.1)


TRANSFORM = (10.0, 0.0, 200000.0, 0.0, -10.0, 1840000.0)


def rasters(spark, d, bands: list[str]) -> str:
    """A folder of GeoTIFF files, one for each tile."""
    folder = files.shared_folder(spark, "rasters")
    sinks.write_rasters(A.pixels(spark, d), bands, folder, SIDE, SIDE, TRANSFORM).agg(F.sum("pixels")).first()
    return folder


def tile_number(column: str = "tile"):
    return F.regexp_extract(column, "([0-9]+)", 1).cast("bigint").alias("tile")


@query
def geotiff_pixels(spark, d):
    """Pixels written to GeoTIFF files and read back, with the centres of their cells; missing ones are left out."""
    p = windows.read_pixels(spark, rasters(spark, d, ["nir", "red"])).where("features[0] is not null and not isnan(features[0])")
    return p.select(tile_number(), C("row").cast("bigint").alias("r"), C("col").cast("bigint").alias("c"), "x", "y", r6(C("features")[0], "nir"), r6(C("features")[1], "red"))


@query
def geotiff_bands(spark, d):
    """The second and the third band of files of three."""
    p = windows.read_pixels(spark, rasters(spark, d, ["nir", "red", "blue"]), [1, 2]).where("features[0] is not null and not isnan(features[0])")
    return p.select(tile_number(), C("row").cast("bigint").alias("r"), C("col").cast("bigint").alias("c"), F.size("features").alias("bands"), r6(C("features")[0], "red"), r6(C("features")[1], "blue"))


@query
def geotiff_metadata(spark, d):
    m = windows.read_metadata(spark, rasters(spark, d, ["nir", "red"]))
    return m.select(tile_number(), "width", "height", "bands", "dtype", "nodata", "epsg", "left", "bottom", "right", "top", F.array_join("descriptions", ",").alias("names"))


@query
def mask_files(spark, d):
    """Masks of 255 written as files and read back: their set pixels."""
    folder = files.shared_folder(spark, "masks")
    done = sinks.write_masks(mask(spark, d), folder, SIDE, SIDE, TRANSFORM, 255).agg(F.sum("pixels")).first()[0]
    p = windows.read_pixels(spark, folder).where(C("features")[0] == 255.0)
    return p.groupBy(tile_number()).agg(F.count("*").alias("pixels"), F.max("row").cast("bigint").alias("last_row")).withColumn("all_tiles", F.lit(done).cast("bigint"))


@query
def picture_files(spark, d):
    """The red overlay written as pictures and read back by the image source, at their own size."""
    folder = files.shared_folder(spark, "pictures")
    over = red_overlay(spark, d)
    sinks.write_pictures(over, folder, SIDE, SIDE).agg(F.count("*")).first()
    read = images.read_images(spark, folder, SIDE).select(tile_number("name"), F.posexplode("values").alias("k", "v"))
    cell = read.groupBy("tile", F.floor(C("k") / (3 * SIDE)).alias("r"), (F.floor(C("k") / 3) % SIDE).alias("c")).agg(*[F.max(F.when(C("k") % 3 == i, C("v"))).cast("int").alias(b) for i, b in enumerate(("red", "green", "blue"))])
    return cell.join(over.select(*ORDER), ORDER, "left_semi")


@query
def export_tiles(spark, d):
    """Tiles written to folders of their own by tasks; a second export finds them there, and readers of a tile skip the others."""
    folder = files.shared_folder(spark, "export")
    write = lambda name, path: sinks.write_tiles(A.pixels(spark, d).select(*ORDER, "nir"), path)
    states = exports.export_regions(spark, ["all"], write, folder) + exports.export_regions(spark, ["all"], write, folder)
    told = ",".join(s for _, s in states)
    return spark.read.parquet(f"{folder}/all").where("tile < 5").groupBy(C("tile").cast("bigint").alias("tile")).agg(F.count("*").alias("pixels"), r6(F.sum("nir"), "nir")).withColumn("states", F.lit(told))


@query
def working_labels(spark, d):
    """Working labels begin as a copy of the master ones, and are not copied again."""
    folder = files.shared_folder(spark, "working")
    p = A.label_points(spark, d).select("id", "lat", "lon", "tile", "label")
    sinks.write_once(p, folder)
    sinks.write_once(p.limit(0), folder)
    return spark.read.parquet(folder)


@query
def training_gate(spark, d):
    """Tiles with labels enough to fit on: more than one."""
    return A.label_points(spark, d).groupBy("tile").agg(F.count("*").alias("rows")).withColumn("enough", C("rows") > 1)


@query
def training_statistics(spark, d):
    """Means and population deviations that a fit keeps, of imputed features."""
    f = A.features(spark, d)
    return fits.statistics_table(f, A.FEATURES, "y").select("feature", r6(C("mean"), "mean"), r6(C("std"), "std"), "rows")


@query
def logistic_gradient(spark, d):
    """Gradient and the diagonal of the curvature of a logistic fit at given weights, sums over all labelled rows."""
    f = A.features(spark, d)
    _, mean, std = fits.statistics(f, A.FEATURES, "y")
    weights = [((k * 5) % 7 - 3) / 10.0 for k in range(len(A.FEATURES) + 1)]
    gradient, curvature = fits.logistic_sums(fits.labelled(f, A.FEATURES, "y", mean, std, 1e-6), weights)
    return spark.createDataFrame([(k, float(g), float(curvature[k, k])) for k, g in enumerate(gradient)], "place int, gradient double, curvature double").select("place", r6(C("gradient"), "gradient"), r6(C("curvature"), "curvature"))


@query
def score_tile(spark, d):
    """Probability and class of every pixel by a model that was saved and read back."""
    folder = files.shared_folder(spark, "model")
    models.save(fixed_linear(), folder)
    scored = models.load(folder).score(A.pixels(spark, d))
    return scored.select(*ORDER, r6(C("p"), "p"), (C("p") >= SETTINGS.positive_probability).cast("int").alias("predicted"))


@query
def saved_ensemble(spark, d):
    """Scores of an ensemble that was saved and read back, of two fixed members."""
    folder = files.shared_folder(spark, "model")
    f = A.features(spark, d)
    one = models.LinearScorer(["f1", "f2"], [0.0, 0.0], [0.125, 0.125], [0.5, -0.25], 0.1)
    two = models.LinearScorer(["f4"], [0.0], [0.25], [1.0], -0.2)
    models.save(models.Ensemble([one, two]), folder)
    return models.load(folder).score(f).select("vec_id", r6(C("p"), "p"))


@query
def validation_metrics(spark, d):
    """Mean cross-entropy and percent right of training and validation pixels."""
    scored = fixed_linear().score(A.pixels(spark, d).withColumnRenamed("p", "q")).withColumn("y", (C("q") >= 0.5).cast("int"))
    part = F.when((C("r") + C("c")) % 5 == 0, "validation").otherwise("train")
    told = F.when(C("y") == 1, C("p")).otherwise(1 - C("p"))
    return scored.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), r6(F.avg(-F.log(told)), "loss"), r6(100 * F.avg(((C("p") >= 0.5).cast("int") == C("y")).cast("double")), "accuracy"))


@query
def window_with_extras(spark, d):
    """Windows of three by three cells around labels, with five indices of the label's own cell z-scored by their normalizers."""
    norms = spark.createDataFrame([("ndvi", 0.5, 0.25), ("evi", 1.0, 0.5), ("evi2", 0.75, 0.25), ("ndwi", 0.1, 0.0), ("nbr_s", 0.2, 0.5)], "feature string, mean double, stdDev double")
    points = placed_labels(spark, d).select(C("id").alias("key"), "tile", "r", "c")
    p = A.pixels(spark, d)
    windows = patches.window_features(points, p.select(*ORDER, F.round("nir", 6).alias("nir"), F.round("red", 6).alias("red")), ["nir", "red"], SIDE, SIDE)
    own = points.join(p, ORDER).select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in X.eps_indices(C("blue"), C("green"), C("red"), C("nir"), C("swir1")).items()])).alias("s")).select("key", "s.*")
    scored = own.join(F.broadcast(norms), "feature").select("key", "feature", stats.zscore_named(C("x"), C("mean"), C("stdDev")).alias("z"))
    extras = scored.groupBy("key").agg(*[F.max(F.when(C("feature") == f, C("z"))).alias(f) for f in ("ndvi", "evi", "evi2", "ndwi", "nbr_s")])
    joined = windows.join(extras, "key")
    whole = F.concat("features", F.array("ndvi", "evi", "evi2", "ndwi", "nbr_s"))
    return joined.select("key", F.size(whole).alias("n"), r6(F.aggregate("features", F.lit(0.0), lambda a, b: a + b), "total"), *[r6(whole[18 + k], f) for k, f in enumerate(("ndvi", "evi", "evi2", "ndwi", "nbr_s"))])


@query
def rgb_band_numbers(spark, d):
    """Red, green and blue by the bands' names, else the first three."""
    k = C("p_partkey")
    names = F.when(k % 4 == 0, F.array(*map(F.lit, ("B2_s1", "B3_s1", "B4_s1")))).when(k % 4 == 1, F.array(*map(F.lit, ("x", "b4", "B3", "B2")))).when(k % 4 == 2, F.array(F.lit("B4"), F.lit(None).cast("string"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    found = X.rgb_band_numbers(names, strict=False)
    return A.read(spark, d, "part").select("p_partkey", found[0].alias("red"), found[1].alias("green"), found[2].alias("blue"))


@query
def settings(spark, d):
    """The settings that results depend on."""
    s = SETTINGS
    rows = {"tile_degrees": s.tile_degrees, "scale_metres": s.scale_metres, "epsg": s.epsg, "seasons": len(s.seasons), "bands": len(s.bands), "min_positives": s.min_positives, "ratio_low": s.ratio_range[0], "ratio_high": s.ratio_range[1], "margin_low": s.margin[0], "margin_high": s.margin[1], "duplicate_degrees": s.duplicate_degrees, "candidates_per_round": s.candidates_per_round, "sieve_pixels": s.sieve_pixels, "patch": s.patch, "inference_patch": s.inference_patch, "epochs": s.epochs, "batch": s.batch, "learning_rate": s.learning_rate, "trees": s.forest["numTrees"], "depth": s.forest["maxDepth"]}
    return spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "name string, value double")


@query
def elapsed_text(spark, d):
    """Durations from an event to the next of its user, as text."""
    e = A.read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gone = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    return e.select("event_id", gone.alias("_s")).where("_s is not null").select("event_id", X.elapsed(C("_s") * 7).alias("elapsed"))


def status_events(spark, d) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("READY", "RUNNING", "COMPLETED", "FAILED"))), (C("event_id") % 4 + 1).cast("int"))
    return A.read(spark, d, "events").select(C("user_id").alias("task"), state.alias("state"), "ts")


@query
def export_states(spark, d):
    """The last state of every export task."""
    return exports.task_states(status_events(spark, d))


@query
def export_stream(spark, d):
    """The last state of every export task, from its events as a stream in small batches."""
    from acreframe.streaming import exports as stream

    folder, schema = files.shared_folder(spark, "events"), A.read(spark, d, "events").schema
    A.read(spark, d, "events").repartition(3).write.parquet(folder)
    state = F.element_at(F.array(*map(F.lit, ("READY", "RUNNING", "COMPLETED", "FAILED"))), (C("event_id") % 4 + 1).cast("int"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder).select(C("user_id").alias("task"), state.alias("state"), "ts")
    out, marks = files.shared_folder(spark, "changes"), files.shared_folder(spark, "marks")
    stream.run(stream.followed(events, delay="3650 days"), out, marks)
    return stream.latest(spark, out).select(C("task").cast("bigint").alias("task"), "state")


@query
def exports_done(spark, d):
    """How many tasks are in a final state, and whether all are."""
    return exports.all_done(exports.task_states(status_events(spark, d)))


@query
def setup_check(spark, d):
    """Inputs that are there before a run, and one that is not."""
    found = exports.check_setup(spark, [f"{d}/{t}.parquet" for t in ("lineitem", "events", "labels", "none")])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "ok")


@query
def manual_labels(spark, d):
    """Points given by hand, put into the first tile that holds them."""
    p = A.label_points(spark, d).select("id", "lat", "lon", "label")
    return labels.manual(p, named_tiles(spark), "id", 0.002, 0.0001).select("id", "tile", "x", "y", "label")


@query
def postprocess_rounds(spark, d):
    """The latest round of versioned predictions, by threshold and sieve: percent of every tile."""
    folder = files.shared_folder(spark, "predictions")
    p = A.pixels(spark, d).select(*ORDER, "p")
    p.withColumn("p", 1 - C("p")).withColumn("round", F.lit(1)).unionByName(p.withColumn("round", F.lit(2))).write.partitionBy("round").parquet(folder)
    return rounds.postprocess(sampling.latest_round(spark.read.parquet(folder)))


def loop(spark, d, rounds_: int) -> tuple[str, list, DataFrame, DataFrame]:
    """The loop from a seed of each tile, the oracle being the pixel's own truth; called round by round, as if it was stopped after each.

    The pixels are made of the order lines once and kept with the bands that the model takes; they come back too.
    """
    p = files.kept(A.pixels(spark, d).select(*ORDER, "nir", "red", "blue"), "pixels")
    truth = p.select(*ORDER, F.when(C("nir") > 25, "Agricultural").otherwise("Non-Agricultural").alias("label"))
    seed = files.kept(sampling.random_per_group(truth, "tile", ORDER, 6).drop("rank"), "seed")
    root, done = files.shared_folder(spark, "loop"), []
    for _ in range(rounds_):
        more, working = rounds.run_loop(spark, root, p, seed, truth, ["nir", "red", "blue"], rounds=1, choice="Logistic")
        done += more
    return root, done, working, p


@query
def loop_labels(spark, d):
    """Labels that the last of two rounds was fitted on."""
    return loop(spark, d, 2)[2]


@query
def loop_summary(spark, d):
    """Rounds of the loop, the labels that the last one was fitted on, and the pixels that the final model scores."""
    root, done, working, p = loop(spark, d, 2)
    scored = rounds.final_model(spark, root).score(p)
    counts = scored.agg(F.count("p").alias("scored"), F.count_if(~C("p").between(0, 1)).alias("outside"))
    return working.agg(F.count("*").alias("labels"), F.countDistinct(*ORDER).alias("places")).crossJoin(counts).withColumn("rounds", F.lit(done[-1].number))


@query
def search_f1(spark, d):
    """The best mean F1 of a search over settings, on a rule that one feature holds."""
    k = C("vec_id")
    f = A.features(spark, d).select("vec_id", (k % 2 * 4 + k * 7 % 11 / 100.0).alias("rule"), (k % 2).cast("int").alias("y"))
    found = models.tune(f, ["rule"], "y", ["vec_id"], svm=[{"c": 1.0, "gamma": "scale"}, {"c": 10.0, "gamma": "auto"}], trees=(5, 10), depths=(2,))
    return spark.createDataFrame([(name, round(best["f1"], 6)) for name, best in found.items()], "model string, f1 double")


@query
def patch_network(spark, d):
    """Scores of patches of 5 by 5 blocks by a residual convolution network, fitted on the patches' own classes."""
    block = A.pixels(spark, d).groupBy("tile", F.floor(C("r") / 4).alias("r"), F.floor(C("c") / 4).alias("c")).agg(F.avg("nir").alias("nir"), F.avg("red").alias("red"), F.avg("p").alias("p"))
    cells = patches.tumbling(block, 5, SIDE // 4, SIDE // 4)
    y = cells.groupBy("tile", "pr", "pc").agg((F.round(F.avg("p"), 9) >= 0.5).cast("int").alias("y"))
    known = patchnet.as_arrays(cells, ["nir", "red"], 5).join(y, ["tile", "pr", "pc"])
    net = patchnet.fit_rows(known, 2, 5, "y", ["tile", "pr", "pc"], width=4, epochs=2)
    return net.score(known).select("tile", "pr", "pc", "y", F.round("p", 6).alias("p"))


@query
def kml_outline(spark, d):
    """Placemarks of each tile's KML document, and the points of their rings, counted in its text."""
    text = polygons_kml(spark, d)
    return text.select("tile", F.regexp_count("kml", F.lit("<Placemark>")).cast("bigint").alias("placemarks"), F.regexp_count("kml", F.lit(",0[ <]")).cast("bigint").alias("points"))


@query
def learnt_rules(spark, d):
    """Classes that each kind of model tells after it was fitted on a rule that one feature holds."""
    k = C("vec_id")
    f = A.features(spark, d).select("vec_id", "f1", (k % 2 * 4 + k * 7 % 11 / 100.0).alias("rule"), (k % 2).cast("int").alias("y"))
    found = [models.train(choice, f, ["rule"], "y", ["vec_id"]).score(f).select(F.lit(choice).alias("model"), "vec_id", (C("p") >= SETTINGS.positive_probability).cast("int").alias("predicted")) for choice in ("Logistic", "SVM", "RandomForest", "ResNet", "Ensemble")]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query
def kernel_score(spark, d):
    """Probabilities of a kernel machine with four given support vectors."""
    import numpy as np

    machine = models.KernelScorer(["f1", "f2"], [0.01, -0.02], [0.125, 0.1], np.array([[0.0, 0.0], [1.0, -1.0], [-1.5, 0.5], [0.5, 2.0]]), np.array([0.75, -1.0, 0.5, -0.25]), 0.1, 0.5, 1.5, -0.2)
    return machine.score(A.features(spark, d)).select("vec_id", F.round("p", 6).alias("p"))
