"""Operators on rasters, scenes, labels and predictions as DataFrames."""
