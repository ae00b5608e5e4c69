"""SQL of another engine that must give the rows of the queries of the same names."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_PIXEL = """pixel AS (SELECT l_suppkey // 4 AS tile, l_partkey % 40 AS r, l_orderkey % 40 AS c, count(*) AS n,
 sum(cast(round(l_discount*100) AS bigint)) / (10e0*count(*)) AS p,
 sum(cast(l_linenumber AS bigint)) / (1e0*count(*)) AS blue, sum(l_partkey % 100) / (1e0*count(*)) AS green,
 sum(cast(round(l_tax*100) AS bigint)) / (1e0*count(*)) AS red, sum(cast(round(l_quantity) AS bigint)) / (1e0*count(*)) AS nir,
 sum(l_suppkey % 50) / (1e0*count(*)) AS swir1, sum(l_orderkey % 70) / (1e0*count(*)) AS swir2 FROM lineitem GROUP BY 1, 2, 3)"""
_SCENE = """scene AS (SELECT user_id // 4 AS tile, event_id % 4 AS r, cast(floor((event_id % 16) / 4e0) AS bigint) AS c, ts,
 CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS season,
 event_id % 4096 AS qa, value / 5 AS cloud_pct, cast(cast(round(value*100) AS bigint) % 1000 AS double) AS B2,
 cast((event_id*7) % 1000 AS double) AS B3, cast((event_id*13) % 1000 AS double) AS B4, cast((event_id*17) % 1000 AS double) AS B8,
 cast((event_id*19) % 1000 AS double) AS B11, cast((event_id*23) % 1000 AS double) AS B12 FROM events)"""
_LABEL = """point AS (SELECT 'rand_' || doc_id AS id, (16644662 + (doc_id*37) % 7842) / 1e6 AS lat, (-24400884 + (doc_id*53) % 7930) / 1e6 AS lon,
 'tile' || (doc_id % 10) AS tile, CASE WHEN toxic = 1 THEN 'Agricultural' ELSE 'Non-Agricultural' END AS label, doc_id AS k FROM labels)"""
_FEATURE = "feature AS (SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, " + ", ".join(f"CASE WHEN vec_id % 7 <> 0 THEN cast(embedding[{i + 1}] AS double) END AS f{i}" if i in (0, 3) else f"cast(embedding[{i + 1}] AS double) AS f{i}" for i in range(8)) + " FROM embeddings)"
_PLACED = _LABEL + """, placed AS (SELECT id, k, label, k % 10 AS tile, cast(floor((16.652504e0 - lat) / 0.0002e0) AS bigint) AS r,
 cast(floor((lon + 24.400884e0) / 0.0002e0) AS bigint) AS c FROM point)"""
# Boxes of the regions, stated apart from the engine's (fixed values).
_ISLAND = """island(name, x0, y0, x1, y1) AS (VALUES ('Testing', -24.400884e0, 16.644662e0, -24.392954e0, 16.652504e0),
 ('Boa_Vista', -22.97435929e0, 15.9576494e0, -22.65365956e0, 16.24065102e0), ('Brava', -24.75129827e0, 14.800214e0, -24.66054963e0, 14.90404257e0),
 ('Fogo', -24.50899065e0, 14.80591421e0, -24.27133253e0, 15.05926771e0), ('Maio', -23.23909088e0, 15.11019894e0, -23.07843073e0, 15.34264497e0),
 ('Sal', -23.0023089e0, 16.58008001e0, -22.86710809e0, 16.85967724e0), ('Santiago', -23.78654553e0, 14.89451334e0, -23.42397171e0, 15.34549301e0),
 ('Santo_Antao', -25.37237221e0, 16.89915026e0, -24.953279e0, 17.21441822e0), ('Sao_Nicolau', -24.4307613e0, 16.47636763e0, -24.00270139e0, 16.68656632e0),
 ('Sao_Vicente', -25.09002776e0, 16.77184887e0, -24.85245664e0, 16.92850691e0))"""
_SCORE = "scored AS (SELECT *, 1 / (1 + exp(-(-3.0e0 + coalesce((nir-red)/nullif(nir+red,0),0)*2.0e0 + nir*0.1e0 + red*(-0.25e0)))) AS prob FROM pixel)"
_BANDS = ("B2", "B3", "B4", "B8", "B11", "B12")


def sql(name: str, *with_: str, body: str, recursive: bool = False) -> None:
    ORACLES[name] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(with_) + " " if with_ else "") + body


def _ndi(a: str, b: str) -> str:
    return f"({a}-{b})/nullif({a}+{b},0)"


def _hash(*parts: str) -> str:
    return "md5('42'" + "".join(f" || '|' || {p}" for p in parts) + ")"


sql("tile_pct_agri", _PIXEL, _SCORE, body="SELECT tile, count(*) AS pixels, cast(sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS bigint) AS agri, round(avg(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END)*100, 6) AS pct_agricultural FROM scored GROUP BY 1")
_CLEAR = "(qa & 1024) = 0 AND (qa & 2048) = 0"
sql("cloud_mask", _SCENE, body=f"SELECT tile, r, c, season, qa, CASE WHEN {_CLEAR} THEN B2 END AS B2, CASE WHEN {_CLEAR} THEN B8 END AS B8 FROM scene")
sql("seasonal_median", _SCENE, body="SELECT tile, r, c, season, " + ", ".join(f"round(median(CASE WHEN {_CLEAR} THEN {b} END), 6) AS {b.lower()}" for b in _BANDS) + " FROM scene WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' AND cloud_pct < 90 AND tile BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4")
sql("spectral_indices", _PIXEL, body=f"SELECT tile, r, c, round({_ndi('nir', 'red')}, 6) AS ndvi, round(2.5e0*(nir-red)/nullif(nir+6e0*red-7.5e0*blue+1,0), 6) AS evi, round(2.5e0*(nir-red)/nullif(nir+2.4e0*red+1,0), 6) AS evi2, round({_ndi('nir', 'swir2')}, 6) AS nbr, round({_ndi('nir', 'swir1')}, 6) AS ndmi FROM pixel")
sql("eps_indices", _PIXEL, body="SELECT tile, r, c, round((nir-red)/(nir+red+1e-6), 6) AS ndvi, round(2.5e0*(nir-red)/(nir+6e0*red-7.5e0*blue+1e0+1e-6), 6) AS evi, round(2.5e0*(nir-red)/(nir+2.4e0*red+1e0+1e-6), 6) AS evi2, round((green-nir)/(green+nir+1e-6), 6) AS ndwi, round((nir-swir1)/(nir+swir1+1e-6), 6) AS nbr_s FROM pixel")
_MEDIANS = ", ".join(f"median(CASE WHEN season = {s} AND {_CLEAR} THEN {b} END) AS {b}_s{s}" for s in (1, 2, 3) for b in _BANDS)
_STACK = ", ".join(f"round({b}_s{s}, 6) AS {b.lower()}_s{s}" for s in (1, 2, 3) for b in _BANDS) + ", " + ", ".join(
    f"round({_ndi(f'B8_s{s}', f'B4_s{s}')}, 6) AS ndvi_s{s}, round(2.5e0*(B8_s{s}-B4_s{s})/nullif(B8_s{s}+6e0*B4_s{s}-7.5e0*B2_s{s}+1,0), 6) AS evi_s{s}, round(2.5e0*(B8_s{s}-B4_s{s})/nullif(B8_s{s}+2.4e0*B4_s{s}+1,0), 6) AS evi2_s{s}, round({_ndi(f'B8_s{s}', f'B12_s{s}')}, 6) AS nbr_s{s}, round({_ndi(f'B8_s{s}', f'B11_s{s}')}, 6) AS ndmi_s{s}" for s in (1, 2, 3))
sql("stacked_bands", _SCENE, f"m AS (SELECT tile, r, c, {_MEDIANS} FROM scene GROUP BY 1, 2, 3)", body=f"SELECT tile, r, c, {_STACK} FROM m")
_COUNTS = "counts AS (SELECT count(*) AS total, count(*) FILTER (WHERE lower(label) = 'agricultural') AS agri FROM point)"
_RATIO = "coalesce(agri*1e0/nullif(total,0), 0)"
sql("label_summary", _LABEL, _COUNTS, body=f"SELECT total, agri, round({_RATIO}, 6) AS ratio, agri >= 10 AND {_RATIO} BETWEEN 0.2 AND 0.3 AS ok, {_RATIO} < 0.2 AS needs_balance FROM counts")
sql("legacy_gate", _LABEL, _COUNTS, body=f"SELECT total, agri, round({_RATIO}, 6) AS ratio, {_RATIO} BETWEEN 0.2 AND 0.3 AS ratio_ok, agri >= 100 AS enough FROM counts")
for _n, _k in (("balanced_subset", 4), ("balanced_subset_legacy", 3), ("balanced_negative_sample", 1)):
    sql(_n, _LABEL, f"ranked AS (SELECT id, label, row_number() OVER (PARTITION BY lower(label) = 'agricultural' ORDER BY {_hash('id')}) AS rk FROM point)", body=f"SELECT id, label FROM ranked WHERE lower(label) = 'agricultural' OR rk <= {_k} * (SELECT count(*) FROM point WHERE lower(label) = 'agricultural')")
sql("near_duplicates", _LABEL, body="SELECT a.id FROM point a WHERE a.k % 2 = 0 AND EXISTS (SELECT 1 FROM point b WHERE b.k % 2 = 1 AND abs(a.lat-b.lat) < 0.0002 AND abs(a.lon-b.lon) < 0.0002 AND sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon)) < 0.0001e0)")
sql("label_binary", _LABEL, body="SELECT id, CASE WHEN lower(label) = 'agricultural' THEN 1 ELSE 0 END AS y FROM point")
sql("margin_candidates", _PIXEL, body="SELECT tile, r, c, round(p, 6) AS p FROM pixel WHERE p BETWEEN 0.4e0 AND 0.6e0 ORDER BY tile, r, c LIMIT 5")
sql("uncertainty_topk", _PIXEL, body="SELECT tile, r, c, round(p, 6) AS p, round(abs(p-0.5e0), 6) AS uncertainty FROM pixel ORDER BY abs(p-0.5e0), tile, r, c LIMIT 5")
ORACLES["round_candidates"] = ORACLES["margin_candidates"]
sql("legacy_uncertainty", _PIXEL, body="SELECT tile, r, c, round(1 - abs((1-p) - p), 6) AS uncertainty FROM pixel WHERE p > 1 - p")
_RANKED = f"ranked AS (SELECT tile, r, c, p, row_number() OVER (PARTITION BY tile ORDER BY {_hash('tile', 'r', 'c')}) AS rank FROM pixel)"
sql("random_per_tile", _PIXEL, _RANKED, body="SELECT tile, r, c, rank FROM ranked WHERE rank <= 5")
sql("unlabeled_antijoin", _PIXEL, body="SELECT tile, r, c FROM pixel WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id % 10 = tile AND doc_id % 40 = r AND (doc_id*3) % 40 = c)")
sql(
    "image_mask_pairs",
    "images AS (SELECT DISTINCT 'Img_' || (doc_id % 100) AS name FROM labels)",
    "masks AS (SELECT 'Img_' || (doc_id % 100) AS name, CASE doc_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.png' WHEN 2 THEN '.jpeg' ELSE '.jpg' END AS ext, CASE doc_id % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS pr FROM labels WHERE doc_id % 3 = 0)",
    "best AS (SELECT name, ext, row_number() OVER (PARTITION BY name ORDER BY pr) AS rk FROM masks)",
    body="SELECT i.name, i.name || b.ext AS mask FROM images i JOIN best b ON i.name = b.name AND b.rk = 1",
)
sql("append_labels", _LABEL, body="SELECT id, lat, lon, tile, label FROM point WHERE k % 2 = 0 UNION ALL SELECT id, lat, lon, tile, label FROM point WHERE k % 2 = 1")
sql("user_plus_model", _LABEL, _PIXEL, body="SELECT tile, k AS x, 'ag' AS predicted, 'user' AS source, cast(NULL AS double) AS uncertainty FROM point WHERE lower(label) = 'agricultural' UNION ALL SELECT 'tile' || tile, c, 'ag', 'model', round(1 - abs(1 - 2*p), 6) FROM pixel WHERE p > 1 - p")
sql("append_tiles", _PIXEL, body="SELECT tile, r, c, round(p, 6) AS p FROM pixel WHERE tile <> 0")
sql("latest_round", "named AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_linenumber*3 END AS round FROM lineitem)", body="SELECT * FROM named WHERE round = (SELECT max(round) FROM named)")
sql("split_80_20", _LABEL, f"ranked AS (SELECT id, row_number() OVER (ORDER BY {_hash('id')}, id) AS rank, count(*) OVER () AS n FROM point)", body="SELECT id, rank, CASE WHEN rank <= floor(0.8e0*n) THEN 'train' ELSE 'validation' END AS part FROM ranked")
sql("shuffled_order", _LABEL, body=f"SELECT id, {_hash('id')} AS h, row_number() OVER (ORDER BY {_hash('id')}, id) AS place FROM point")
_REGION = "region_ AS (SELECT *, 0.05e0 AS cap FROM island UNION ALL SELECT tile, min(lon), min(lat), max(lon), max(lat), 0.002e0 FROM point GROUP BY 1)"
sql(
    "tile_grid",
    _ISLAND,
    _LABEL,
    _REGION,
    "sized AS (SELECT *, cast(greatest(1, ceil((x1-x0)/cap)) AS int) AS cols, cast(greatest(1, ceil((y1-y0)/cap)) AS int) AS nrows FROM region_)",
    "steps AS (SELECT cast(unnest(range(0, 20)) AS int) AS s)",
    body="SELECT name AS island, cast(a.s*nrows + b.s AS int) AS tile_idx, a.s AS i, b.s AS j, round(x0 + a.s*((x1-x0)/cols), 9) AS x0, round(y0 + b.s*((y1-y0)/nrows), 9) AS y0, round(x0 + (a.s+1)*((x1-x0)/cols), 9) AS x1, round(y0 + (b.s+1)*((y1-y0)/nrows), 9) AS y1 FROM sized, steps a, steps b WHERE a.s < cols AND b.s < nrows",
)
_QUARTER = "quarter AS (SELECT 'q' || i || j AS tile, -24.400884e0 + i*0.003965e0 AS x0, 16.644662e0 + j*0.003921e0 AS y0, -24.400884e0 + (i+1)*0.003965e0 AS x1, 16.644662e0 + (j+1)*0.003921e0 AS y1 FROM (VALUES (0,0),(0,1),(1,0),(1,1)) v(i, j) UNION ALL SELECT 'z_over', -24.3975e0, 16.6465e0, -24.3955e0, 16.6505e0)"
sql("tile_of_point", _LABEL, _QUARTER, body="SELECT id, coalesce((SELECT min(q.tile) FROM quarter q WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1), 'unknown') AS tile FROM point")
sql("bbox_lookup", _LABEL, body="SELECT count(*) AS n, round(min(lon), 6) AS x0, round(min(lat), 6) AS y0, round(max(lon), 6) AS x1, round(max(lat), 6) AS y1 FROM point WHERE lon BETWEEN -24.400884e0 AND -24.396919e0 AND lat BETWEEN 16.644662e0 AND 16.648583e0")
sql("affine_roundtrip", _PIXEL, body="SELECT tile, r, c, 200000e0 + (c+0.5e0)*10 AS x, 1840000e0 - (r+0.5e0)*10 AS y, cast(r AS int) AS row2, cast(c AS int) AS col2 FROM pixel")
sql("ring_mean", _PIXEL, body="SELECT tile, r, c, round(200000e0 + (4*(c+1e0) + c+0.5e0)/5*10, 6) AS mean_x, round(1840000e0 - (4*(r+1e0) + r+0.5e0)/5*10, 6) AS mean_y, round(200000e0 + (c+0.5e0)*10, 6) AS center_x, round(1840000e0 - (r+0.5e0)*10, 6) AS center_y FROM pixel")
# Zone 27 north of WGS84 by the published series (n of the ellipsoid to the fourth power), from the ellipsoid's two numbers.
_UTM = """q AS (SELECT 6378137e0 AS a, 1e0/298.257223563e0 AS fl), w AS (SELECT a, fl/(2-fl) AS n, sqrt(fl*(2-fl)) AS ec FROM q),
 h AS (SELECT ec, a/(1+n)*(1 + n*n/4 + n*n*n*n/64)*0.9996e0 AS big, n/2 - 2*n*n/3 + 5*n*n*n/16 + 41*n*n*n*n/180 AS a1, 13*n*n/48 - 3*n*n*n/5 + 557*n*n*n*n/1440 AS a2,
  61*n*n*n/240 - 103*n*n*n*n/140 AS a3, 49561*n*n*n*n/161280 AS a4 FROM w),
 g AS (SELECT id, radians(lat) AS phi, radians(lon + 21e0) AS lam FROM point),
 t AS (SELECT h.*, id, lam, sinh(atanh(sin(phi)) - ec * atanh(ec * sin(phi))) AS t FROM g, h),
 e AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t*t)) AS eta FROM t)"""
_EAST = "eta" + "".join(f" + a{k}*cos({2 * k}*xi)*sinh({2 * k}*eta)" for k in (1, 2, 3, 4))
_NORTH = "xi" + "".join(f" + a{k}*sin({2 * k}*xi)*cosh({2 * k}*eta)" for k in (1, 2, 3, 4))
sql("utm_forward", _LABEL, _UTM, body=f"SELECT id, round(500000e0 + big*({_EAST}), 3) AS x, round(big*({_NORTH}), 3) AS y FROM e")
# The way back, and tiles in degrees whose cells are looked up by the centres of a grid of 10 m.
_BACK = [("n/2 - 2*n*n/3 + 37*n*n*n/96 - n*n*n*n/360", 1), ("n*n/48 + n*n*n/15 - 437*n*n*n*n/1440", 2), ("17*n*n*n/480 - 37*n*n*n*n/840", 3), ("4397*n*n*n*n/161280", 4)]
_SPOTS = " UNION ALL ".join(f"SELECT tile AS id, lat0 - 0.0001e0*40*{a} AS lat, lon0 + 0.0001e0*40*{b} AS lon FROM box" for a in ("0e0", "0.5e0", "1e0") for b in ("0e0", "0.5e0", "1e0"))
_WARP = (
    "box AS (SELECT DISTINCT tile, tile % 200 * 0.0041e0 - 24.4e0 AS lon0, floor(tile / 200) * 0.0041e0 + 16.65e0 AS lat0 FROM pixel)",
    f"point AS ({_SPOTS})",
    _UTM,
    f"met AS (SELECT id AS tile, 500000e0 + big*({_EAST}) AS x, big*({_NORTH}) AS y FROM e)",
    "span AS (SELECT tile, cast(floor(min(x)/10) AS bigint) AS x0, cast(ceil(max(x)/10) AS bigint) AS x1, cast(floor(min(y)/10) AS bigint) AS y0, cast(ceil(max(y)/10) AS bigint) AS y1 FROM met GROUP BY 1)",
    "grid AS (SELECT tile, gx, unnest(range(y0, y1)) AS gy FROM (SELECT *, unnest(range(x0, x1)) AS gx FROM span) u)",
    "zone AS (SELECT tile, gx, gy, ((gy + 0.5e0)*10) / h.big AS xi0, ((gx + 0.5e0)*10 - 500000e0) / h.big AS eta0, h.ec, w.n FROM grid, h, w)",
    "turn AS (SELECT *, xi0 - (" + " + ".join(f"({b})*sin({2 * k}*xi0)*cosh({2 * k}*eta0)" for b, k in _BACK) + ") AS xi, eta0 - (" + " + ".join(f"({b})*cos({2 * k}*xi0)*sinh({2 * k}*eta0)" for b, k in _BACK) + ") AS eta FROM zone)",
    "psi AS (SELECT *, asinh(sin(xi) / sqrt(sinh(eta)*sinh(eta) + cos(xi)*cos(xi))) AS psi FROM turn)",
    "back AS (SELECT tile, gx, gy, degrees(asin(list_reduce(list_prepend(tanh(psi), [1e0, 2e0, 3e0, 4e0, 5e0, 6e0, 7e0, 8e0]), lambda s, k: tanh(psi + ec*atanh(ec*s))))) AS lat, -21e0 + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM psi)",
    "seen AS (SELECT back.tile, gx, gy, (lat0 - lat)/0.0001e0 AS fr, (lon - lon0)/0.0001e0 AS fc FROM back JOIN box ON box.tile = back.tile), inside AS (SELECT * FROM seen WHERE fr >= 0 AND fc >= 0 AND fr < 40 AND fc < 40)",
)
sql("warp_nearest", _PIXEL, *_WARP, body="SELECT i.tile, gx, gy, p.r, p.c, round(nir, 6) AS nir, round(red, 6) AS red FROM inside i JOIN pixel p ON p.tile = i.tile AND p.r = floor(fr) AND p.c = floor(fc)")
_FOURFOLD = "four AS (SELECT tile, gx, gy, greatest(least(floor(fr - 0.5e0) + a, 39), 0) AS r, greatest(least(floor(fc - 0.5e0) + b, 39), 0) AS c, CASE a WHEN 1 THEN fr - 0.5e0 - floor(fr - 0.5e0) ELSE 1 - (fr - 0.5e0 - floor(fr - 0.5e0)) END * CASE b WHEN 1 THEN fc - 0.5e0 - floor(fc - 0.5e0) ELSE 1 - (fc - 0.5e0 - floor(fc - 0.5e0)) END AS w FROM inside, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b))"
sql("warp_bilinear", _PIXEL, *_WARP, _FOURFOLD, body="SELECT f.tile, gx, gy, round(sum(w*nir)/sum(w), 4) AS nir, round(sum(w*red)/sum(w), 4) AS red FROM four f LEFT JOIN pixel p ON p.tile = f.tile AND p.r = f.r AND p.c = f.c WHERE w > 0 GROUP BY 1, 2, 3 HAVING count(*) = count(nir)")
sql("utm_roundtrip", _LABEL, body="SELECT id, true AS close FROM point")
sql("pixel_at_label", _PLACED, _PIXEL, body="SELECT id, placed.tile, placed.r, placed.c, round(nir, 6) AS nir, round(red, 6) AS red FROM placed LEFT JOIN pixel ON placed.tile = pixel.tile AND placed.r = pixel.r AND placed.c = pixel.c")
sql("label_features", _PLACED, _PIXEL, body="SELECT id, CASE WHEN lower(label) = 'agricultural' THEN 1 ELSE 0 END AS y, " + ", ".join(f"round({b}, 6) AS f{i}" for i, b in enumerate(("blue", "green", "red", "nir", "swir1", "swir2"))) + " FROM placed JOIN pixel ON placed.tile = pixel.tile AND placed.r = pixel.r AND placed.c = pixel.c")
sql("label_tile_rejects", _LABEL, body="SELECT id, tile FROM point WHERE tile IN ('tile7', 'tile8', 'tile9')")
_WINDOW = "origin AS (SELECT id, tile, greatest(least(r-1, 37), 0) AS r0, greatest(least(c-1, 37), 0) AS c0 FROM placed), cell AS (SELECT id, tile, r0 + a.s AS r, c0 + b.s AS c, 3*a.s + b.s AS k FROM origin, (VALUES (0),(1),(2)) a(s), (VALUES (0),(1),(2)) b(s)), got AS (SELECT id, k, coalesce(round(nir, 6), 0) AS nir, coalesce(round(red, 6), 0) AS red FROM cell LEFT JOIN pixel ON cell.tile = pixel.tile AND cell.r = pixel.r AND cell.c = pixel.c)"
sql("window3x3_features", _PLACED, _PIXEL, _WINDOW, body="SELECT id AS key, cast(2*count(*) AS int) AS n, round(sum(nir + red), 6) AS total, max(CASE WHEN k = 0 THEN nir END) AS first, max(CASE WHEN k = 8 THEN red END) AS last FROM got GROUP BY 1")
# Points beyond their tile have no window in its file.
sql("window_reads", _PLACED, _PIXEL, _WINDOW, "held AS (SELECT id FROM placed WHERE r BETWEEN 0 AND 39 AND c BETWEEN 0 AND 39 AND tile IN (SELECT tile FROM pixel))", body="SELECT id AS key, cast(2*count(*) AS int) AS n, round(sum(nir + red), 6) AS total, max(CASE WHEN k = 0 THEN nir END) AS first, max(CASE WHEN k = 8 THEN red END) AS last FROM got WHERE id IN (SELECT id FROM held) GROUP BY 1")
sql("centred_patch", _PLACED, body="SELECT id, greatest(least(r-8, 24), 0) AS r0, greatest(least(c-8, 24), 0) AS c0 FROM placed")


def _patch(side: int) -> str:
    return f"patch AS (SELECT *, cast(floor(r/{side}e0)*{side} AS bigint) AS pr, cast(floor(c/{side}e0)*{side} AS bigint) AS pc FROM pixel), full_ AS (SELECT * FROM patch WHERE pr + {side} <= 40 AND pc + {side} <= 40)"


sql("patch_minmax", _PIXEL, _patch(16), "z AS (SELECT tile, pr, pc, (nir - min(nir) OVER w) / (max(nir) OVER w - min(nir) OVER w + 1e-5) AS z FROM full_ WINDOW w AS (PARTITION BY tile, pr, pc))", body="SELECT tile, pr, pc, count(*) AS n, round(sum(z), 4) AS total, round(max(z), 6) AS top FROM z GROUP BY 1, 2, 3")
sql("patch_counts", "size_ AS (SELECT p_partkey AS tile, cast(p_size*20 AS bigint) AS h, (p_partkey*7) % 900 AS w FROM part)", body="SELECT tile, cast(CASE WHEN h >= 64 AND w >= 64 THEN (floor((h-64)/64e0)+1) * (floor((w-64)/64e0)+1) ELSE 0 END AS bigint) AS sliding, cast(floor(h/64e0)*floor(w/64e0) AS bigint) AS full FROM size_")
_PATCHP = "patchp AS (SELECT tile, pr, pc, avg(p) AS p FROM full_ GROUP BY 1, 2, 3)"
sql("patch_inference", _PIXEL, _patch(8), _PATCHP, body="SELECT tile, pr, pc, round(p, 9) AS p, CASE WHEN round(p, 9) > round(1-p, 9) THEN 'ag' ELSE 'non-ag' END AS predicted FROM patchp")
sql("patch_to_pixel_mask", _PIXEL, _patch(8), _PATCHP, body="SELECT f.tile, r, c, CASE WHEN round(q.p, 9) >= 0.5 THEN 255 ELSE 0 END AS mask FROM full_ f JOIN patchp q ON f.tile = q.tile AND f.pr = q.pr AND f.pc = q.pc")
sql("per_band_minmax", _PIXEL, body="SELECT tile, r, c, round((nir - min(nir) OVER w) / (max(nir) OVER w - min(nir) OVER w + 1e-5), 6) AS nir, round((red - min(red) OVER w) / (max(red) OVER w - min(red) OVER w + 1e-5), 6) AS red FROM pixel WINDOW w AS (PARTITION BY tile)")
_STRETCH = "ends AS (SELECT tile, min(least(red, green, blue)) AS lo, max(greatest(red, green, blue)) AS hi FROM pixel GROUP BY 1)"
sql("rgb_stretch", _PIXEL, _STRETCH, body="SELECT p.tile, r, c, " + ", ".join(f"cast(least(greatest(floor(({b}-lo)/(hi-lo+1e-5)*255), 0), 255) AS int) AS {b}" for b in ("red", "green", "blue")) + " FROM pixel p JOIN ends e ON p.tile = e.tile")
sql("red_overlay", _PIXEL, body="SELECT tile, r, c, cast(CASE WHEN p >= 0.5 THEN 255 ELSE floor(red) END AS int) AS red, cast(CASE WHEN p >= 0.5 THEN 0 ELSE floor(green) END AS int) AS green, cast(CASE WHEN p >= 0.5 THEN 0 ELSE floor(blue) END AS int) AS blue FROM pixel")
sql("mask255", _PIXEL, body="SELECT tile, r, c, 255 AS mask FROM pixel WHERE p >= 0.5")


def _bits(part: str) -> str:
    return f"cast('0x' || substr({_hash('tile', 'pr', 'pc', repr(part))}, 1, 4) AS bigint)"


sql(
    "augment_patch",
    _PIXEL,
    _patch(8),
    f"flags AS (SELECT tile, pr, pc, r-pr AS r, c-pc AS c, round(p, 6) AS p, {_bits('h')} % 2 AS h, {_bits('v')} % 2 AS v, {_bits('t')} % 4 AS t FROM full_)",
    "flipped AS (SELECT *, CASE WHEN v = 1 THEN 7-r ELSE r END AS a, CASE WHEN h = 1 THEN 7-c ELSE c END AS b FROM flags)",
    body="SELECT tile, pr, pc, r, c, CASE t WHEN 0 THEN a WHEN 1 THEN 7-b WHEN 2 THEN 7-a ELSE b END AS r2, CASE t WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN 7-b ELSE 7-a END AS c2, p FROM flipped",
)
_NINE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
_HORN = "sent AS (SELECT tile, r - dr AS r, c - dc AS c, dr, dc, nir FROM pixel, (VALUES " + ", ".join(f"({a},{b})" for a, b in _NINE) + ") o(dr, dc)), horn AS (SELECT tile, r, c, " + ", ".join(f"max(CASE WHEN dr = {a} AND dc = {b} THEN nir END) AS z{a + 1}{b + 1}" for a, b in _NINE) + " FROM sent GROUP BY 1, 2, 3 HAVING count(*) = 9)"
_GRAD = "grad AS (SELECT tile, r, c, ((z02+2*z12+z22)-(z00+2*z10+z20))/8 AS dx, ((z20+2*z21+z22)-(z00+2*z01+z02))/8 AS dy FROM horn), turn AS (SELECT *, degrees(atan(sqrt(dx*dx+dy*dy))) AS slope, degrees(atan2(dy, -dx)) AS t FROM grad)"
sql("terrain_slope_aspect", _PIXEL, _HORN, _GRAD, body="SELECT tile, r, c, round(slope, 5) AS slope, round(CASE WHEN slope > 1e-9 THEN CASE WHEN t > 90 THEN 450 - t ELSE 90 - t END END, 5) AS aspect FROM turn")


def _reach(steps: str) -> str:
    """Cells that a cell without a smaller neighbour reaches, without a bound on steps: the first cell of a component is one."""
    return f"one AS (SELECT tile, r*40 + c AS k, r, c FROM pixel WHERE p >= 0.5), step(dr, dc) AS (VALUES {steps}), edge AS (SELECT a.tile, a.k, b.k AS k2 FROM one a, step s, one b WHERE b.tile = a.tile AND b.r = a.r + s.dr AND b.c = a.c + s.dc), reach(tile, k, root) AS (SELECT tile, k, k FROM one WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.tile = one.tile AND edge.k = one.k AND edge.k2 < one.k) UNION SELECT e.tile, e.k2, reach.root FROM reach JOIN edge e ON e.tile = reach.tile AND e.k = reach.k WHERE e.k2 > reach.root), comp AS (SELECT tile, k, min(root) AS root FROM reach GROUP BY 1, 2)"


_FOUR = "(0,1),(1,0),(0,-1),(-1,0)"
_ALL = "(0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,1),(-1,-1)"
sql("components4", _PIXEL, _reach(_FOUR), body="SELECT tile, cast(floor(k/40e0) AS bigint) AS r, k % 40 AS c, root FROM comp", recursive=True)
sql("components8", _PIXEL, _reach(_ALL), body="SELECT tile, root, count(*) AS n FROM comp GROUP BY 1, 2", recursive=True)
sql("field_sizes", _PIXEL, _reach(_FOUR), "sizes AS (SELECT tile, root, count(*) AS n FROM comp GROUP BY 1, 2)", body="SELECT tile, count(*) AS fields, cast(sum(n) AS bigint) AS pixels, max(n) AS largest, round(avg(n), 6) AS mean FROM sizes GROUP BY 1", recursive=True)
sql("polygon_count", _PIXEL, _reach(_FOUR), body="SELECT tile, count(DISTINCT root) AS polygons, count(*) AS pixels FROM comp GROUP BY 1", recursive=True)
sql("auto_tune_params", _PIXEL, _reach(_FOUR), "sizes AS (SELECT tile, root, count(*) AS n FROM comp GROUP BY 1, 2)", body="SELECT cast(floor((SELECT quantile_cont(n, 0.1) FROM sizes)) AS int) AS min_field, round((SELECT quantile_cont(abs(p-0.5e0), 0.4) FROM pixel), 6) AS uncertainty_low, round((SELECT quantile_cont(abs(p-0.5e0), 0.6) FROM pixel), 6) AS uncertainty_high", recursive=True)
_ONE = "one AS (SELECT tile, r, c FROM pixel WHERE p >= 0.5)"
sql("adjacency_pairs", _PIXEL, _ONE, body="SELECT a.tile, a.r, a.c, b.r AS r2, b.c AS c2 FROM one a JOIN one b ON a.tile = b.tile AND ((a.r = b.r AND a.c + 1 = b.c) OR (a.r + 1 = b.r AND a.c = b.c))")


def _edge(neighbour: str, r1: str, c1: str, r2: str, c2: str) -> str:
    return f"SELECT tile, {r1} AS r1, {c1} AS c1, {r2} AS r2, {c2} AS c2 FROM one o WHERE NOT EXISTS (SELECT 1 FROM one n WHERE n.tile = o.tile AND {neighbour})"


sql("boundary_edges", _PIXEL, _ONE, body=" UNION ALL ".join([_edge("n.r = o.r - 1 AND n.c = o.c", "r", "c", "r", "c + 1"), _edge("n.r = o.r AND n.c = o.c + 1", "r", "c + 1", "r + 1", "c + 1"), _edge("n.r = o.r + 1 AND n.c = o.c", "r + 1", "c + 1", "r + 1", "c"), _edge("n.r = o.r AND n.c = o.c - 1", "r + 1", "c", "r", "c")]))
sql("candidate_kml", _PIXEL, _RANKED, "box AS (SELECT tile, r, c, 200000 + c*10 AS x0, 1840000 - r*10 - 10 AS y0 FROM ranked WHERE rank <= 2)", body="SELECT tile, r, c, x0 || ',' || y0 || ',0 ' || (x0+10) || ',' || y0 || ',0 ' || (x0+10) || ',' || (y0+10) || ',0 ' || x0 || ',' || (y0+10) || ',0 ' || x0 || ',' || y0 || ',0' AS ring FROM box")
sql("patch_footprint", _LABEL, "s AS (SELECT id, lat, lon, CASE WHEN k % 10 = 9 THEN 0.001e0 ELSE 3*((k % 10 + 1)/1000e0) END AS side FROM point)", body="SELECT id, round(lon - side/2, 6) AS x0, round(lat - side/2, 6) AS y0, round(lon + side/2, 6) AS x1, round(lat + side/2, 6) AS y1 FROM s")
sql("tile_clip", _PIXEL, "spot AS (SELECT tile, r, c, 200000e0 + (c+0.5e0)*7.5e0 AS x, 1840000e0 - (r+0.5e0)*7.5e0 AS y FROM pixel)", body="SELECT tile, r, c, cast(floor((x-200000)/10) AS bigint) AS gx, cast(floor((1840000-y)/10) AS bigint) AS gy FROM spot WHERE x BETWEEN 200050 AND 200200 AND y BETWEEN 1839750 AND 1839950")
sql("tile_extent", _PIXEL, body="SELECT tile, max(r)+1 AS rows, max(c)+1 AS cols, count(*) AS pixels FROM pixel GROUP BY 1")
_FULL = "mean_ AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}" for i in range(8)) + " FROM feature), full_ AS (SELECT vec_id, " + ", ".join(f"coalesce(f{i}, m{i}) AS f{i}" for i in range(8)) + " FROM feature, mean_)"
sql("feature_stats", _FEATURE, _FULL, body=" UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(avg(f{i}), 6) AS mean, round(min(f{i}), 6) AS low, round(max(f{i}), 6) AS high, round(var_pop(f{i}), 6) AS variance FROM full_" for i in range(8)))
sql("impute_zscore", _FEATURE, _FULL, "s AS (SELECT " + ", ".join(f"avg(f{i}) AS a{i}, stddev_pop(f{i}) AS s{i}" for i in (0, 1, 3)) + " FROM full_)", body="SELECT vec_id, " + ", ".join(f"round((f{i}-a{i})/(s{i}+1e-6), 5) AS f{i}" for i in (0, 1, 3)) + " FROM full_, s")
sql("standardise_pop", _FEATURE, body="SELECT vec_id, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 5) AS z FROM feature")
sql("zscore_named", _FEATURE, body="SELECT vec_id, 'f1' AS feature, round((f1-0.01e0)/0.1e0, 6) AS z FROM feature UNION ALL SELECT vec_id, 'f2', round(f2, 6) FROM feature UNION ALL SELECT vec_id, 'f4', round((f4+0.02e0)/0.125e0, 6) FROM feature")
sql("softmax_score", _FEATURE, "z AS (SELECT vec_id, f6, f1 + 0.5e0*f2 AS a, 2*f4 - f5 AS b FROM feature)", body="SELECT vec_id, round(1/(1+exp(a-b)), 6) AS p1, CASE WHEN b > a THEN 1 ELSE 0 END AS class, round(greatest(f6, 0), 6) AS relu FROM z")
sql("accuracy_f1", _PIXEL, "q AS (SELECT CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y, CASE WHEN nir >= 25 THEN 1 ELSE 0 END AS q FROM pixel)", body="SELECT round(100*avg(CASE WHEN y = q THEN 1e0 ELSE 0 END), 6) AS accuracy, round(2e0*sum(y*q)/nullif(sum(y+q), 0), 6) AS f1 FROM q")
sql("ndvi_bounds_by_month", body="SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0.25e0 WHEN month(o_orderdate) BETWEEN 3 AND 6 THEN 0.2e0 WHEN month(o_orderdate) BETWEEN 8 AND 10 THEN 0.3e0 ELSE 0.25e0 END AS low, 0.85e0 AS high FROM orders")
sql("candidate_ids", _PIXEL, _RANKED, body=f"SELECT tile, r, c, 'AL_3_' || substr({_hash('tile', 'r', 'c')}, 1, 12) AS id FROM ranked WHERE rank <= 5")
sql("pending_candidates", _LABEL, body="SELECT id, tile FROM point WHERE k % 3 = 0 ORDER BY k LIMIT 10")
_FIRST = "first_ AS (SELECT tile, lat, lon, min(l) AS l FROM listed GROUP BY 1, 2, 3)"
_UNION = "spot AS (SELECT tile, (16600000 + cast(round((k % 50)*4/10e0) AS bigint))/1e6 AS lat, (-24400000 + cast(round((k % 20)*4/10e0) AS bigint))/1e6 AS lon, k FROM point), listed AS (SELECT tile, lat, lon, 0 AS l FROM spot WHERE k % 3 <> 0 UNION ALL SELECT tile, lat, lon, 1 FROM spot WHERE k % 2 = 0)"
sql("candidate_union", _LABEL, _UNION, _FIRST, body="SELECT CASE l WHEN 0 THEN 'rand' ELSE 'marg' END || '_' || tile || '_' || (row_number() OVER (PARTITION BY tile, l ORDER BY lat, lon) - 1) AS id, tile, lat, lon, '' AS label FROM first_")
_MARGIN = f"margin_ AS (SELECT tile, r, c, row_number() OVER (PARTITION BY tile ORDER BY {_hash('tile', 'r', 'c')}) AS rank FROM pixel WHERE p BETWEEN 0.4e0 AND 0.6e0), listed AS (SELECT tile, r/100e0 AS lat, c/100e0 AS lon, 0 AS l FROM ranked WHERE rank <= 5 UNION ALL SELECT tile, r/100e0, c/100e0, 1 FROM margin_ WHERE rank <= 3)"
sql("hybrid_candidates", _PIXEL, _RANKED, _MARGIN, _FIRST, body="SELECT CASE l WHEN 0 THEN 'rand' ELSE 'marg' END || '_' || tile || '_' || (row_number() OVER (PARTITION BY tile, l ORDER BY lat, lon) - 1) AS id, tile, round(lat, 6) AS lat, round(lon, 6) AS lon FROM first_")
_UNIT = "cast('0x' || substr(md5('42|' || name || '|' || '{0}' || '|' || k), 1, 8) AS bigint) / 4294967296e0"
sql("roi_points", _ISLAND, _LABEL, _REGION, "k AS (SELECT cast(unnest(range(0, 50)) AS int) AS k)", body=f"SELECT name, k, round(x0 + {_UNIT.format('lon')}*(x1-x0), 9) AS lon, round(y0 + {_UNIT.format('lat')}*(y1-y0), 9) AS lat FROM region_, k")
_CELL = "cast('0x' || substr(md5('42|' || tile || '|' || '{0}' || '|' || k), 1, 8) AS bigint)"
sql("random_pixels", _PIXEL, "e AS (SELECT tile, max(r)+1 AS h, max(c)+1 AS w FROM pixel GROUP BY 1)", "k AS (SELECT cast(unnest(range(0, 20)) AS int) AS k)", body=f"SELECT tile, k, {_CELL.format('r')} % h AS r, {_CELL.format('c')} % w AS c FROM e, k")
sql("running_ag_ratio", _LABEL, body="SELECT id, round(coalesce(sum(CASE WHEN lower(label) = 'agricultural' THEN 1e0 ELSE 0 END) OVER w / nullif(count(*) OVER w, 0), 0), 6) AS ag_ratio FROM point WINDOW w AS (PARTITION BY tile ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
sql("valid_rows", body="SELECT 'T' || doc_id || '.TIF' AS image_file, doc_id AS x, doc_id*2 AS y FROM labels WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
sql("block_mean", _PIXEL, body="SELECT tile, cast(floor(r/4e0) AS bigint) AS br, cast(floor(c/4e0) AS bigint) AS bc, round(avg(nir), 9) AS nir FROM pixel GROUP BY 1, 2, 3")
sql("nearest_resize", _PIXEL, "small AS (SELECT tile, cast(floor(r/4e0) AS bigint) AS br, cast(floor(c/4e0) AS bigint) AS bc, CASE WHEN round(avg(p), 9) >= 0.5 THEN 1 ELSE 0 END AS v FROM pixel GROUP BY 1, 2, 3)", "k AS (SELECT cast(unnest(range(0, 40)) AS bigint) AS k)", body="SELECT tile, a.k AS r, b.k AS c, v FROM small JOIN k a ON floor((a.k+0.5e0)/4) = br JOIN k b ON floor((b.k+0.5e0)/4) = bc")
sql("postprocess_summary", _PIXEL, "s AS (SELECT tile, 1/(1+exp(-(0.1e0 + (nir-25)/(10+1e-6) - 0.5e0*((red-4)/(2+1e-6))))) AS p FROM pixel)", body="SELECT 'tile' || tile AS tile, round_even(round(avg(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)*100, 6), 2) AS pct_agricultural FROM s GROUP BY 1")

sql(
    "stack_with_terrain", _SCENE, _PIXEL, f"m AS (SELECT tile, r, c, {_MEDIANS} FROM scene GROUP BY 1, 2, 3)", _HORN, _GRAD,
    body=f"SELECT m.tile, m.r, m.c, round(B2_s1, 6) AS b2_s1, round(B8_s2, 6) AS b8_s2, round({_ndi('B8_s3', 'B4_s3')}, 6) AS ndvi_s3, round({_ndi('B8_s1', 'B12_s1')}, 6) AS nbr_s1, round(p.nir, 6) AS elevation, round(slope, 5) AS slope, round(CASE WHEN slope > 1e-9 THEN CASE WHEN t > 90 THEN 450 - t ELSE 90 - t END END, 5) AS aspect, 36 AS bands FROM m JOIN pixel p ON m.tile = p.tile AND m.r = p.r AND m.c = p.c LEFT JOIN turn u ON u.tile = m.tile AND u.r = m.r AND u.c = m.c",
)
sql("scene_bounds", _SCENE, body="SELECT tile, r, c, count(*) AS n FROM scene WHERE season = 2 AND ts >= TIMESTAMP '2024-01-11' AND cloud_pct < 60 AND r <= 2 AND r + 1 >= 1.5 AND c <= 1 AND c + 1 >= 0.5 GROUP BY 1, 2, 3")
sql("scene_collection", _SCENE, body="SELECT tile, r, c, season, count(*) AS n, sum(B2) AS b2, max(qa) AS qa FROM scene WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21' AND cloud_pct < 60 AND tile BETWEEN 3 AND 40 GROUP BY 1, 2, 3, 4")
sql("expression_dsl", _PIXEL, body="SELECT tile, r, c, round(2.5e0*(nir-red)/(nir+2.4e0*red+1), 6) AS evi2 FROM pixel")
sql("overlay_points", _PIXEL, _RANKED, "dot AS (SELECT tile, r, c FROM ranked WHERE rank <= 2)", body="SELECT p.tile, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM dot WHERE dot.tile = p.tile AND (dot.r-p.r)*(dot.r-p.r) + (dot.c-p.c)*(dot.c-p.c) <= 4)) AS marked, count(*) AS pixels FROM pixel p GROUP BY 1")
sql("answered_candidates", _LABEL, body="SELECT id, tile, CASE WHEN k % 2 = 1 THEN 'Agricultural' WHEN k % 3 <> 0 THEN label ELSE '' END AS label FROM point")
sql("label_batch", _LABEL, body="SELECT id, label FROM point a WHERE a.k % 2 = 1 OR NOT EXISTS (SELECT 1 FROM point b WHERE b.k % 2 = 1 AND abs(a.lat-b.lat) < 0.0002 AND abs(a.lon-b.lon) < 0.0002 AND sqrt((a.lat-b.lat)*(a.lat-b.lat) + (a.lon-b.lon)*(a.lon-b.lon)) < 0.0001e0)")
sql("legacy_candidates", _PIXEL, "e AS (SELECT tile, max(r)+1 AS h, max(c)+1 AS w FROM pixel GROUP BY 1)", "k AS (SELECT cast(unnest(range(0, 40)) AS int) AS k)", f"q AS (SELECT tile, k, {_CELL.format('r')} % h AS r, {_CELL.format('c')} % w AS c FROM e, k)", body="SELECT tile, r, c, k, 1e0 AS uncertainty FROM q WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id % 10 = q.tile AND doc_id % 40 = q.r AND (doc_id*3) % 40 = q.c)")
sql("check_results_report", _LABEL, _COUNTS, _PIXEL, _patch(8), _PATCHP, body=f"SELECT 'user' AS source, total AS rows, agri AS ag, round({_RATIO}, 6) AS ratio FROM counts UNION ALL SELECT 'model', count(*), count(*) FILTER (WHERE round(p, 9) > round(1-p, 9)), round(count(*) FILTER (WHERE round(p, 9) > round(1-p, 9)) * 1e0 / nullif(count(*), 0), 6) FROM patchp")


def _dense(layer: int, of: str, rows: int, cols: int) -> str:
    """A linear layer of the fixed network over a list."""
    total = f"list_sum(list_transform(range({rows}), lambda i: {of}[i+1] * (((i*37 + j*101 + {layer * 53 + 11}) % 199 - 99) / (99e0*sqrt({rows}e0)))))"
    return f"list_transform(range({cols}), lambda j: {total} + ((j*29 + {layer * 7}) % 13 - 6)/60e0)"


def _normed(layer: int, of: str) -> str:
    """Normalisation and ReLU of the fixed network over a list."""
    return f"list_transform(range(64), lambda j: greatest(0e0, ({of}[j+1] - ((j*11 + {layer}) % 9 - 4)/50e0) / sqrt(0.5e0 + ((j*13 + {layer}) % 8)/10e0 + 1e-5) * (1 + ((j*5 + {layer}) % 7 - 3)/20e0) + ((j*3 + {layer}) % 5 - 2)/10e0))"


sql(
    "resnet_forward",
    _FEATURE,
    "x0 AS (SELECT vec_id, [" + ", ".join(f"coalesce(f{i}, 0)/(0.125e0+1e-6)" for i in range(8)) + "] AS x FROM feature)",
    f"x1 AS (SELECT vec_id, {_dense(0, 'x', 8, 64)} AS u FROM x0)",
    f"x2 AS (SELECT vec_id, {_normed(0, 'u')} AS h FROM x1)",
    f"x3 AS (SELECT vec_id, h, {_dense(1, 'h', 64, 64)} AS u FROM x2)",
    f"x4 AS (SELECT vec_id, h, {_normed(1, 'u')} AS g FROM x3)",
    "x5 AS (SELECT vec_id, list_transform(range(64), lambda j: h[j+1] + g[j+1]) AS h FROM x4)",
    f"x6 AS (SELECT vec_id, h, {_dense(2, 'h', 64, 64)} AS u FROM x5)",
    f"x7 AS (SELECT vec_id, h, {_normed(2, 'u')} AS g FROM x6)",
    "x8 AS (SELECT vec_id, list_transform(range(64), lambda j: h[j+1] + g[j+1]) AS h FROM x7)",
    f"x9 AS (SELECT vec_id, {_dense(3, 'h', 64, 2)} AS z FROM x8)",
    body="SELECT vec_id, round(1/(1 + exp(z[1] - z[2])), 6) AS p FROM x9",
)
# The legacy loop, a label at a time.
sql(
    "label_refusal",
    _LABEL,
    "queue AS (SELECT tile, k, lower(label) = 'agricultural' AS pos, row_number() OVER (PARTITION BY tile ORDER BY k) AS turn FROM point)",
    "walk(tile, turn, k, taken, p, n) AS (SELECT tile, cast(0 AS bigint), cast(0 AS bigint), false, cast(0 AS bigint), cast(0 AS bigint) FROM queue GROUP BY 1 UNION ALL SELECT * FROM (SELECT tile, turn, k, take, p + CASE WHEN take AND pos THEN 1 ELSE 0 END, n + CASE WHEN take AND NOT pos THEN 1 ELSE 0 END FROM (SELECT w.tile, q.turn, q.k, q.pos, w.p, w.n, q.pos OR (w.p + w.n > 0 AND w.p*1e0/nullif(w.p + w.n, 0) >= 0.25e0) AS take FROM walk w JOIN queue q ON q.tile = w.tile AND q.turn = w.turn + 1) x) y)",
    body="SELECT tile, k FROM walk WHERE taken",
    recursive=True,
)


def _sieved(value: str, least: int) -> tuple[str, ...]:
    """Eight-connected regions of both values; small ones take the value of their largest neighbour if that is not small."""
    return (
        f"cell AS (SELECT tile, r*40 + c AS k, r, c, {value} AS v FROM {'scored' if 'prob' in value else 'pixel'})",
        f"step(dr, dc) AS (VALUES {_ALL})",
        "near AS (SELECT a.tile, a.k, b.k AS k2, a.v = b.v AS same FROM cell a, step s, cell b WHERE b.tile = a.tile AND b.r = a.r + s.dr AND b.c = a.c + s.dc)",
        "edge AS (SELECT * FROM near WHERE same)",
        "reach(tile, k, root) AS (SELECT tile, k, k FROM cell WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.tile = cell.tile AND edge.k = cell.k AND edge.k2 < cell.k) UNION SELECT e.tile, e.k2, reach.root FROM reach JOIN edge e ON e.tile = reach.tile AND e.k = reach.k WHERE e.k2 > reach.root)",
        "comp AS (SELECT tile, k, min(root) AS root FROM reach GROUP BY 1, 2)",
        "size_ AS (SELECT tile, root, count(*) AS n FROM comp GROUP BY 1, 2)",
        "pair AS (SELECT DISTINCT n.tile, a.root AS x, b.root AS y FROM near n JOIN comp a ON a.tile = n.tile AND a.k = n.k JOIN comp b ON b.tile = n.tile AND b.k = n.k2 WHERE NOT n.same)",
        f"best AS (SELECT p.tile, p.x, p.y, s.n AS big, row_number() OVER (PARTITION BY p.tile, p.x ORDER BY s.n DESC, p.y) AS rk FROM pair p JOIN size_ s ON s.tile = p.tile AND s.root = p.y JOIN size_ o ON o.tile = p.tile AND o.root = p.x WHERE o.n < {least})",
        f"after AS (SELECT c.tile, c.k, coalesce(o.v, c.v) AS v FROM cell c JOIN comp m ON m.tile = c.tile AND m.k = c.k LEFT JOIN best b ON b.tile = c.tile AND b.x = m.root AND b.rk = 1 AND b.big >= {least} LEFT JOIN cell o ON o.tile = b.tile AND o.k = b.y)",
    )


sql("sieve50", _PIXEL, *_sieved("CASE WHEN p >= 0.5 THEN 1 ELSE 0 END", 50), body="SELECT tile, count(*) AS pixels, cast(sum(v) AS bigint) AS agri, round(avg(v)*100, 6) AS pct_agricultural FROM after GROUP BY 1", recursive=True)
sql("classify_and_sieve", _PIXEL, _SCORE, *_sieved("CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END", 20), body="SELECT tile, cast(sum(v) AS bigint) AS agri, round(avg(v)*100, 6) AS pct_agricultural FROM after GROUP BY 1", recursive=True)
# Rings: every side of a region's border, directed with the region on its right, leads to the next one; at a corner where two
# rings touch it turns right. A ring is walked from each of its sides that begins at a corner none of its neighbours begins before.
_SIDES = " UNION ALL ".join(
    f"SELECT o.tile, o.root, o.r + {a} AS r1, o.c + {b} AS c1, o.r + {x} AS r2, o.c + {y} AS c2 FROM spot o WHERE NOT EXISTS (SELECT 1 FROM spot n WHERE n.tile = o.tile AND n.r = o.r + {dr} AND n.c = o.c + {dc})"
    for dr, dc, a, b, x, y in ((-1, 0, 0, 0, 0, 1), (0, 1, 0, 1, 1, 1), (1, 0, 1, 1, 1, 0), (0, -1, 1, 0, 0, 0))
)
sql(
    "exterior_ring",
    _PIXEL,
    _reach(_FOUR),
    "spot AS (SELECT tile, root, cast(floor(k/40e0) AS bigint) AS r, k % 40 AS c FROM comp)",
    f"side AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY r1, c1, r2, c2) AS id FROM ({_SIDES}) x)",
    "follow AS (SELECT a.tile, a.root, a.id, a.r1, a.c1, a.r2, a.c2, b.id AS after, row_number() OVER (PARTITION BY a.tile, a.id ORDER BY CASE WHEN b.r2 = a.r2 + (a.c2-a.c1) AND b.c2 = a.c2 - (a.r2-a.r1) THEN 0 ELSE 1 END) AS rk, b.r2-b.r1 AS dr, b.c2-b.c1 AS dc FROM side a JOIN side b ON b.tile = a.tile AND b.r1 = a.r2 AND b.c1 = a.c2)",
    "link AS (SELECT * FROM follow WHERE rk = 1)",
    "walk(tile, start, id) AS (SELECT l.tile, l.id, l.id FROM link l JOIN link b ON b.tile = l.tile AND b.after = l.id WHERE l.id < b.id AND l.id < l.after UNION SELECT w.tile, w.start, l.after FROM walk w JOIN link l ON l.tile = w.tile AND l.id = w.id)",
    "ringed AS (SELECT tile, id, min(start) AS ring FROM walk GROUP BY 1, 2)",
    "ring AS (SELECT l.tile, l.root, g.ring, sum(l.c1*l.r2 - l.c2*l.r1)/2e0 AS area, count(*) FILTER (WHERE l.r2-l.r1 <> l.dr OR l.c2-l.c1 <> l.dc) + 1 AS corners FROM link l JOIN ringed g ON g.tile = l.tile AND g.id = l.id GROUP BY 1, 2, 3)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY tile, root ORDER BY area DESC) AS rk, count(*) OVER (PARTITION BY tile, root) AS n FROM ring)",
    body="SELECT tile, cast(floor(root/40e0) AS bigint) AS root_r, root % 40 AS root_c, cast(corners AS int) AS corners, round(area, 1) AS outer_area, cast(n - 1 AS int) AS holes, 'EPSG:32627' AS crs FROM ranked WHERE rk = 1",
    recursive=True,
)
# The outer rings walked side by side from their least corner, their turns as points in degrees, and the text of each tile.
_RING = ORACLES["exterior_ring"].partition("SELECT tile, cast(floor(root/40e0) AS bigint) AS root_r")[0].rstrip()
ORACLES["polygons_kml"] = f"""{_RING}, outer_ AS (SELECT tile, root, ring FROM ranked WHERE rk = 1),
 path(tile, root, ring, id, k, turn) AS (SELECT tile, root, ring, ring, 0, true FROM outer_ UNION ALL SELECT p.tile, p.root, p.ring, l.after, p.k + 1, l.r2-l.r1 <> l.dr OR l.c2-l.c1 <> l.dc FROM path p JOIN link l ON l.tile = p.tile AND l.id = p.id WHERE l.after <> p.ring),
 spots AS (SELECT p.tile, p.root, p.k, l.r1, l.c1 FROM path p JOIN link l ON l.tile = p.tile AND l.id = p.id WHERE turn UNION ALL SELECT p.tile, p.root, 1000000000, l.r1, l.c1 FROM path p JOIN link l ON l.tile = p.tile AND l.id = p.id WHERE p.k = 0),
 {_UTM[: _UTM.index("g AS (SELECT id")].rstrip().rstrip(",")},
 zone AS (SELECT tile, root, k, (1840000e0 - r1*10e0) / h.big AS xi0, (200000e0 + c1*10e0 - 500000e0) / h.big AS eta0, h.ec, w.n FROM spots, h, w),
 turned AS (SELECT *, xi0 - ({" + ".join(f"({b})*sin({2 * k}*xi0)*cosh({2 * k}*eta0)" for b, k in _BACK)}) AS xi, eta0 - ({" + ".join(f"({b})*cos({2 * k}*xi0)*sinh({2 * k}*eta0)" for b, k in _BACK)}) AS eta FROM zone),
 psi AS (SELECT *, asinh(sin(xi) / sqrt(sinh(eta)*sinh(eta) + cos(xi)*cos(xi))) AS psi FROM turned),
 degree AS (SELECT tile, root, k, round(degrees(asin(list_reduce(list_prepend(tanh(psi), [1e0, 2e0, 3e0, 4e0, 5e0, 6e0, 7e0, 8e0]), lambda s, z: tanh(psi + ec*atanh(ec*s))))), 7) AS lat, round(-21e0 + degrees(atan2(sinh(eta), cos(xi))), 7) AS lon FROM psi),
 mark AS (SELECT tile, root, '<Placemark><name>field_' || cast(floor(root/40e0) AS bigint) || '_' || (root % 40) || '</name><Polygon><outerBoundaryIs><LinearRing><coordinates>' || string_agg(lon || ',' || lat || ',0', ' ' ORDER BY k) || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS kml FROM degree GROUP BY 1, 2)
SELECT tile, count(*) AS placemarks, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' || string_agg(kml, '' ORDER BY root) || '</Document></kml>' AS kml FROM mark GROUP BY 1"""

_XY = "200000e0 + (c+0.5e0)*10 AS x, 1840000e0 - (r+0.5e0)*10 AS y"
sql("geotiff_pixels", _PIXEL, body=f"SELECT tile, r, c, {_XY}, round(nir, 6) AS nir, round(red, 6) AS red FROM pixel")
sql("geotiff_bands", _PIXEL, body="SELECT tile, r, c, 2 AS bands, round(red, 6) AS red, round(blue, 6) AS blue FROM pixel")
sql("geotiff_metadata", _PIXEL, body="SELECT DISTINCT tile, 40 AS width, 40 AS height, 2 AS bands, 'float64' AS dtype, -9999e0 AS nodata, 32627 AS epsg, 200000e0 AS \"left\", 1839600e0 AS bottom, 200400e0 AS \"right\", 1840000e0 AS top, 'nir,red' AS names FROM pixel")
sql("mask_files", _PIXEL, body="SELECT tile, count(*) AS pixels, max(r) AS last_row, (SELECT count(*) FROM pixel WHERE p >= 0.5) AS all_tiles FROM pixel WHERE p >= 0.5 GROUP BY 1")
sql("export_tiles", _PIXEL, body="SELECT tile, count(*) AS pixels, round(sum(nir), 6) AS nir, 'COMPLETED,COMPLETED' AS states FROM pixel WHERE tile < 5 GROUP BY 1")
sql("working_labels", _LABEL, body="SELECT id, lat, lon, tile, label FROM point")
sql("training_gate", _LABEL, body="SELECT tile, count(*) AS rows, count(*) > 1 AS enough FROM point GROUP BY 1")
sql("training_statistics", _FEATURE, _FULL, body=" UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(avg(f{i}), 6) AS mean, round(stddev_pop(f{i}), 6) AS std, count(*) AS rows FROM full_" for i in range(8)))
_AT = [((k * 5) % 7 - 3) / 10 for k in range(9)]
_Z = "zs AS (SELECT y, " + ", ".join(f"(f{i} - avg(f{i}) OVER ())/(stddev_pop(f{i}) OVER () + 1e-6) AS z{i}" for i in range(8)) + ", 1e0 AS z8 FROM (SELECT full_.*, y FROM full_ JOIN feature USING (vec_id)) j)"
sql("logistic_gradient", _FEATURE, _FULL, _Z, "told AS (SELECT *, 1/(1+exp(-(" + " + ".join(f"({w}e0)*z{i}" for i, w in enumerate(_AT)) + "))) AS q FROM zs)", body=" UNION ALL ".join(f"SELECT {i} AS place, round(sum(z{i}*(y-q)), 6) AS gradient, round(sum(z{i}*z{i}*q*(1-q)), 6) AS curvature FROM told" for i in range(9)))
_LINEAR = "1/(1+exp(-(0.1e0 + (nir-25)/(10+1e-6) - 0.5e0*((red-4)/(2+1e-6)))))"
sql("score_tile", _PIXEL, f"s AS (SELECT tile, r, c, {_LINEAR} AS p FROM pixel)", body="SELECT tile, r, c, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted FROM s")
sql("saved_ensemble", _FEATURE, body="SELECT vec_id, round((1/(1+exp(-(0.1e0 + 0.5e0*f1/(0.125e0+1e-6) - 0.25e0*f2/(0.125e0+1e-6)))) + 1/(1+exp(-(-0.2e0 + f4/(0.25e0+1e-6)))))/2, 6) AS p FROM feature")
sql("validation_metrics", _PIXEL, f"s AS (SELECT CASE WHEN (r+c) % 5 = 0 THEN 'validation' ELSE 'train' END AS part, {_LINEAR} AS q, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS y FROM pixel)", body="SELECT part, count(*) AS rows, round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1-q END)), 6) AS loss, round(100*avg(CASE WHEN (q >= 0.5) = (y = 1) THEN 1e0 ELSE 0 END), 6) AS accuracy FROM s GROUP BY 1")
sql("window_with_extras", _PLACED, _PIXEL, _WINDOW, "flat AS (SELECT id, sum(nir + red) AS total FROM got GROUP BY 1)", body="SELECT id AS key, 23 AS n, round(total, 6) AS total, round(((nir-red)/(nir+red+1e-6)-0.5e0)/0.25e0, 6) AS ndvi, round((2.5e0*(nir-red)/(nir+6e0*red-7.5e0*blue+1e0+1e-6)-1e0)/0.5e0, 6) AS evi, round((2.5e0*(nir-red)/(nir+2.4e0*red+1e0+1e-6)-0.75e0)/0.25e0, 6) AS evi2, round((green-nir)/(green+nir+1e-6)-0.1e0, 6) AS ndwi, round(((nir-swir1)/(nir+swir1+1e-6)-0.2e0)/0.5e0, 6) AS nbr_s FROM placed JOIN pixel ON placed.tile = pixel.tile AND placed.r = pixel.r AND placed.c = pixel.c JOIN flat USING (id)")
sql("rgb_band_numbers", body="SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS red, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS green, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 3 END AS blue FROM part")
sql("settings", body="SELECT * FROM (VALUES ('tile_degrees', 0.05e0), ('scale_metres', 10e0), ('epsg', 32627e0), ('seasons', 3e0), ('bands', 6e0), ('min_positives', 10e0), ('ratio_low', 0.2e0), ('ratio_high', 0.3e0), ('margin_low', 0.4e0), ('margin_high', 0.6e0), ('duplicate_degrees', 0.0001e0), ('candidates_per_round', 5e0), ('sieve_pixels', 50e0), ('patch', 64e0), ('inference_patch', 256e0), ('epochs', 10e0), ('batch', 32e0), ('learning_rate', 0.001e0), ('trees', 100e0), ('depth', 8e0)) v(name, value)")
sql("elapsed_text", "g AS (SELECT event_id, 7*(cast(floor(epoch(lead(ts) OVER w)) AS bigint) - cast(floor(epoch(ts)) AS bigint)) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))", body="SELECT event_id, CASE WHEN s // 86400 = 1 THEN '1 day, ' WHEN s // 86400 > 1 THEN (s // 86400) || ' days, ' ELSE '' END || ((s % 86400) // 3600) || ':' || lpad(cast((s % 3600) // 60 AS varchar), 2, '0') || ':' || lpad(cast(s % 60 AS varchar), 2, '0') AS elapsed FROM g WHERE s IS NOT NULL")
_STATES = "told AS (SELECT user_id AS task, CASE event_id % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'COMPLETED' ELSE 'FAILED' END AS state, ts FROM events), last_ AS (SELECT task, state, row_number() OVER (PARTITION BY task ORDER BY ts DESC, state DESC) AS rk FROM told)"
sql("export_states", _STATES, body="SELECT task, state FROM last_ WHERE rk = 1")
ORACLES["export_stream"] = ORACLES["export_states"]
sql("exports_done", _STATES, body="SELECT count(*) AS tasks, count(*) FILTER (WHERE state IN ('COMPLETED', 'FAILED')) AS final, count(*) = count(*) FILTER (WHERE state IN ('COMPLETED', 'FAILED')) AS done FROM last_ WHERE rk = 1")
sql("setup_check", body="SELECT * FROM (VALUES ('lineitem.parquet', true), ('events.parquet', true), ('labels.parquet', true), ('none.parquet', false)) v(name, ok)")
sql("manual_labels", _LABEL, _QUARTER, "put AS (SELECT id, lat, lon, label, (SELECT min(q.tile) FROM quarter q WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1) AS tile FROM point)", body="SELECT id, put.tile, cast(floor((lon-x0)/0.0001e0) AS int) AS x, cast(floor((y1-lat)/0.0001e0) AS int) AS y, label FROM put JOIN quarter q ON q.tile = put.tile")
sql("postprocess_rounds", _PIXEL, *_sieved("CASE WHEN p >= 0.5 THEN 1 ELSE 0 END", 50), body="SELECT tile, round_even(avg(v)*100, 2) AS pct_agricultural FROM after GROUP BY 1", recursive=True)
ORACLES["picture_files"] = ORACLES["red_overlay"]
sql("kml_outline", body=f"SELECT tile, count(*) AS placemarks, cast(sum(corners) AS bigint) AS points FROM ({ORACLES['exterior_ring']}) x GROUP BY 1")
sql("learnt_rules", body="SELECT model, vec_id, vec_id % 2 AS predicted FROM embeddings, (VALUES ('Logistic'), ('SVM'), ('RandomForest'), ('ResNet'), ('Ensemble')) m(model)")
_BASIS = " + ".join(f"({w}e0)*exp(-0.5e0*((a-({x}e0))*(a-({x}e0)) + (b-({y}e0))*(b-({y}e0))))" for w, x, y in ((0.75, 0.0, 0.0), (-1.0, 1.0, -1.0), (0.5, -1.5, 0.5), (-0.25, 0.5, 2.0)))
sql("kernel_score", _FEATURE, "z AS (SELECT vec_id, (f1-0.01e0)/0.125e0 AS a, (f2+0.02e0)/0.1e0 AS b FROM feature)", body=f"SELECT vec_id, round(1/(1+exp(-(1.5e0*({_BASIS} + 0.1e0) - 0.2e0))), 6) AS p FROM z")
sql("loop_summary", _PIXEL, "t AS (SELECT tile, least(count(*), 6) AS n FROM pixel GROUP BY 1)", body="SELECT cast(sum(n) AS bigint) + 5 AS labels, cast(sum(n) AS bigint) + 5 AS places, (SELECT count(*) FROM pixel) AS scored, 0 AS outside, 2 AS rounds FROM t")
sql("search_f1", body="SELECT * FROM (VALUES ('SVM', 1e0), ('RandomForest', 1e0)) v(model, f1)")
ORACLES |= {"components_in_blocks": ORACLES["components4"], "sieve_in_blocks": ORACLES["sieve50"], "rings_in_blocks": ORACLES["exterior_ring"]}
