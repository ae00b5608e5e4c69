"""acreframe: land-use raster and label analytics expressed as Spark DataFrames."""
