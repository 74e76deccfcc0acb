"""Raster, annotation and training-data analytics expressed as Spark DataFrames."""
