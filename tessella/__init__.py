"""Tiled rasters and large-scale text preparation as PySpark DataFrames."""
