"""Rasters that change: patches of tiles, as a batch or as a stream."""
