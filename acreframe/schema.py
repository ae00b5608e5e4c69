"""Record types of labels, predictions, tiles and summaries; files are read by these, by name, never by position."""

from pyspark.sql import types as T


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()
LABEL = _of(id=S, lat=D, lon=D, tile=S, label=S)
CANDIDATE = _of(id=S, tile=S, lat=D, lon=D, label=S)
LEGACY_LABEL = _of(image_file=S, x=I, y=I, lat=D, lon=D, label=S)
PREDICTION = _of(tile=S, row_idx=I, col_idx=I, center_lat=D, center_lon=D, predicted_prob=D)
LEGACY_PREDICTION = _of(image_file=S, x=I, y=I, lon=D, lat=D, predicted=S, source=S, uncertainty=D)
NORMALIZER = _of(feature=S, mean=D, stdDev=D)
SUMMARY = _of(tile=S, pct_agricultural=D)
TILE_META = _of(tile=S, height=I, width=I, a=D, b=D, c=D, d=D, e=D, f=D, crs=S, nodata=D)
