"""Operators on rasters: pixels as rows, tiles as rows, and the layout of files."""
