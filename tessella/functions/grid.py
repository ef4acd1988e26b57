"""The arithmetic of pyramids and tile grids, for single rasters and as columns for tables of rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: TIFF directories have no more levels than an image of 2**62 pixels a side could use.
MOST_LEVELS = 62
#: An edge chunk of so many pixels or fewer joins the chunk before it.
THIN_CHUNK = 12
#: Tiles that a task spells out at once.
PIECE = 1 << 16


def halved(n: int, times: int = 1) -> int:
    """The length of an axis after so many halvings: floor, but one pixel at least."""
    return max(1, n >> times)


def tile_count(n: int, blocksize: int) -> int:
    return -(-n // blocksize)


def overview_levels(width: int, height: int, minsize: int = 256, count: int | None = None) -> int:
    """How many overviews an image gets: until both sides are at most minsize or, with a count, until
    the count is reached or one pixel is left."""
    longest, level = max(width, height), 0
    least = minsize if count is None else 1
    while longest >> level > least and (count is None or level < count):
        level += 1
    return level


def overview_levels_column(width: Column, height: Column, minsize: Column, count: Column) -> Column:
    """The same of a table of images; a null count is none.

    The sides only shrink, so the number of levels is how many powers of two still leave too much.
    """
    longest = F.greatest(width, height).cast("long")
    least = F.when(count.isNull(), minsize).otherwise(F.lit(1))
    steps = F.size(F.filter(F.sequence(F.lit(0), F.lit(MOST_LEVELS)), lambda k: F.call_function("shiftright", longest, k) > least))
    return F.when(count.isNull(), steps).otherwise(F.least(steps, count)).cast("int")


def level_dims(images: DataFrame) -> DataFrame:
    """Adds level, level_width and level_height: a row for each level of each image (columns width, height, levels)."""
    out = images.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels"))))

    def side(name: str) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.call_function("shiftright", F.col(name).cast("long"), F.col("level")))

    return out.withColumn("level_width", side("width")).withColumn("level_height", side("height"))


def tile_grid(levels: DataFrame) -> DataFrame:
    """A row for each tile of each level (columns level_width, level_height, blocksize): tile_row, tile_col, tile_height, tile_width.

    There are as many tiles as the images' area says, however few the images are: levels are cut into pieces of
    at most PIECE tiles, which are dealt to all tasks before they are spelt out.
    """
    spark = levels.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = F.col("blocksize").cast("long")

    def last(side: str) -> Column:
        return F.ceil(F.col(side) / F.col("blocksize")) - 1

    def starts(end: Column, step: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), end, step))

    def places(start: str, end: str, step: str) -> Column:
        return F.explode(F.sequence(F.col(start), F.least(F.col(start) + F.col(step) - 1, F.col(end))))

    # A piece is whole rows of tiles, or a run of tiles of one row.
    out = levels.withColumn("__bottom", last("level_height")).withColumn("__right", last("level_width"))
    out = out.withColumn("__wide", F.lit(PIECE).cast("long")).withColumn("__high", F.greatest(F.lit(1).cast("long"), F.call_function("div", F.lit(PIECE), F.col("__right") + 1)))
    out = out.withColumn("__top", starts(F.col("__bottom"), F.col("__high"))).withColumn("__left", starts(F.col("__right"), F.col("__wide")))
    out = out.repartition(tasks, *levels.columns, "__top", "__left")
    out = out.withColumn("tile_row", places("__top", "__bottom", "__high")).withColumn("tile_height", F.least(size, F.col("level_height") - F.col("tile_row") * size))
    out = out.withColumn("tile_col", places("__left", "__right", "__wide")).withColumn("tile_width", F.least(size, F.col("level_width") - F.col("tile_col") * size))
    return out.select(*levels.columns, "tile_row", "tile_col", "tile_height", "tile_width")


def ifd_types(levels: DataFrame) -> DataFrame:
    """Adds the field types of each level's directory: short_dims (both sides fit 16 bits), n_tiles, and
    whether the byte count of a lone tile stands in the entry itself, as a LONG8."""
    tiles = F.ceil(F.col("level_width") / F.col("blocksize")) * F.ceil(F.col("level_height") / F.col("blocksize"))
    return levels.select(
        "*",
        F.when(F.col("level_width") < 65536, "SHORT").otherwise("LONG").alias("width_type"),
        F.when(F.col("level_height") < 65536, "SHORT").otherwise("LONG").alias("height_type"),
        tiles.cast("long").alias("n_tiles"),
        F.when(tiles == 1, "LONG8").otherwise("LONG").alias("count_type"),
    )


def halo_trims(chunks: DataFrame) -> DataFrame:
    """Adds top, bottom, left and right: what a chunk that got a halo must give back on each side, null
    on a side without a neighbour and where the halo is zero (columns chunk_row, chunk_col, chunk_rows, chunk_cols, halo)."""
    some = F.col("halo") > 0
    return chunks.select(
        "*",
        F.when(some & (F.col("chunk_row") > 0), F.col("halo")).alias("top"),
        F.when(some & (F.col("chunk_row") < F.col("chunk_rows") - 1), -F.col("halo")).alias("bottom"),
        F.when(some & (F.col("chunk_col") > 0), F.col("halo")).alias("left"),
        F.when(some & (F.col("chunk_col") < F.col("chunk_cols") - 1), -F.col("halo")).alias("right"),
    )


def chunk_sizes(length: Column, chunk: Column) -> Column:
    """The sizes of an axis cut into chunks: all of one size but the last."""
    full = F.array_repeat(chunk, F.call_function("div", length, chunk).cast("int"))
    rest = F.pmod(length, chunk)
    return F.when(rest > 0, F.concat(full, F.array(rest))).otherwise(full)


def merged_edge(sizes: Column, least: int = THIN_CHUNK) -> Column:
    """The sizes of an axis with a thin last chunk joined to the one before it."""
    n = F.size(sizes)
    joined = F.concat(F.slice(sizes, 1, n - 2), F.array(F.element_at(sizes, -2) + F.element_at(sizes, -1)))
    return F.when((n > 1) & (F.element_at(sizes, -1) <= least), joined).otherwise(sizes)


def interior_multiple(sizes: Column, blocksize: Column) -> Column:
    """Whether every chunk but the last is a multiple of the block size."""
    return F.forall(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), lambda s: F.pmod(s, blocksize) == 0)


def interior_equal(sizes: Column, blocksize: Column) -> Column:
    """Whether every chunk but the last is one block."""
    return F.forall(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), lambda s: s == blocksize)
