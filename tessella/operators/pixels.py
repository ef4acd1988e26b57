"""Rasters as rows of pixels: band, r, c, v, and valid where a mask is known.

This form serves relational work: joins with other tables, sparse rasters, checks.  Dense rasters are
kept as tiles (operators.tiles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("MAXIMUM", "MEAN", "MINIMUM", "STDDEV", "VALID_PERCENT")


def from_arrays(rows: DataFrame, row: str, values: str, value: Column | None = None, band: int = 1) -> DataFrame:
    """Pixels of a table that has one row of the image in each row, as an array.

    value: what the pixel is, of the column "x" (the array's element).
    """
    cells = rows.select(F.col(row).cast("int").alias("r"), F.posexplode(values).alias("c", "x"))
    return cells.select(F.lit(band).alias("band"), "r", "c", (F.col("x") if value is None else value).alias("v"))


def masked(pixels: DataFrame, mask: DataFrame | None = None, nodata: float | None = None) -> DataFrame:
    """Adds valid: in the mask (r, c; all bands; null: no mask) and not nodata.

    NaN equals NaN in Spark, so a NaN nodata value is met by the same comparison.
    """
    nothing = F.lit(False) if nodata is None else F.col("v") == F.lit(nodata)
    if mask is None:
        return pixels.withColumn("valid", ~nothing & F.col("v").isNotNull())
    known = mask.where("valid").select("r", "c", F.lit(True).alias("in_mask"))
    return pixels.join(known, ["r", "c"], "left").select(*pixels.columns, (F.coalesce("in_mask", F.lit(False)) & ~nothing & F.col("v").isNotNull()).alias("valid"))


def band_stats(pixels: DataFrame, exact: bool = True) -> DataFrame:
    """band, max, mean, min, std (of the population) and valid_percent, over valid pixels.

    exact: for whole-numbered pixels; sums are decimals, so the deviation does not depend on the order.
    Where they or their products need more than 38 digits (10**9 pixels near the ends of 32 bits), the
    deviation is that of means and spreads, as for other pixels.
    """
    v = F.when(F.col("valid"), F.col("v"))
    if exact:
        n, total = F.count(v), F.try_sum(v.cast("decimal(20,0)"))
        square = F.try_sum(F.try_multiply(v.cast("decimal(19,0)"), v.cast("decimal(19,0)")))
        spread = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), square), F.try_multiply(total, total))
        std = F.coalesce(F.sqrt(spread.cast("double")) / F.nullif(n, F.lit(0)), F.stddev_pop(v))
    else:
        std = F.stddev_pop(v)
    percent = F.lit(100.0) * (F.lit(1.0) - F.avg(F.when(F.col("valid"), 0).otherwise(1)))
    return pixels.groupBy("band").agg(F.max(v).cast("double").alias("max"), F.avg(v).alias("mean"), F.min(v).cast("double").alias("min"), std.alias("std"), percent.alias("valid_percent"))


def stats_tags(stats: DataFrame) -> DataFrame:
    """band, name and value: a row a tag; only the share of valid pixels where none is valid."""
    names = [f"STATISTICS_{s}" for s in STATISTICS]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in zip(names, ("max", "mean", "min", "std", "valid_percent"), strict=True)))
    return stats.select("band", F.inline(pairs)).where((F.col("name") == names[-1]) | F.col("value").isNotNull())


def in_tiles(pixels: DataFrame, blocksize: int) -> DataFrame:
    """Adds tile_row, tile_col and the place in the tile, y and x."""
    tile = lambda c: F.call_function("div", F.col(c), F.lit(blocksize)).cast("int")
    return pixels.select("*", tile("r").alias("tile_row"), tile("c").alias("tile_col"), (F.col("r") % blocksize).alias("y"), (F.col("c") % blocksize).alias("x"))


def halo_rows(pixels: DataFrame, blocksize: int, halo: int) -> DataFrame:
    """Pixels of tiles with a halo: each pixel goes to its own tile and to those whose halo holds it
    (tile_row, tile_col, band, r, c, v, own).  Tiles without a pixel of their own get none."""
    near = lambda c: F.array_distinct(F.transform(F.array(F.col(c) - halo, F.col(c), F.col(c) + halo), lambda x: F.floor(x / blocksize).cast("int")))
    # A halo is no wider than a block, so three points find all tiles.
    sent = pixels.select("band", "r", "c", "v", F.explode(near("r")).alias("tile_row"))
    sent = sent.select("*", F.explode(near("c")).alias("tile_col"))
    own = (F.call_function("div", F.col("r"), F.lit(blocksize)) == F.col("tile_row")) & (F.call_function("div", F.col("c"), F.lit(blocksize)) == F.col("tile_col"))
    out = sent.select("tile_row", "tile_col", "band", "r", "c", "v", own.alias("own"))
    tiles = in_tiles(pixels, blocksize).select("tile_row", "tile_col").distinct()
    return out.join(tiles, ["tile_row", "tile_col"], "left_semi")
