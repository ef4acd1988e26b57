"""Where the bytes of a written raster lie, as rows.

index: level, tile_row, tile_col, is_mask, nbytes of the tiles that have bytes.  A file holds the header,
then the smallest level first, each row by row, a tile's mask after its image.  Offsets are running sums
over that order, made in two steps so that no task sorts all tiles: first over the totals of tile rows
(one number a row of tiles), then within each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of multipart uploads: fixed values of the S3 protocol.
MAX_PARTS, MIN_PART, MAX_PART, MAX_FILE = 10_000, 5 << 20, 5 << 30, 5 << 40
#: Bytes before and after a block that has a leader and a trailer.
LEADER = TRAILER = 4
#: Places of a row of tiles (image and mask) that are spelt out at once.
RUN = 1 << 13


def file_order(tiles: DataFrame) -> DataFrame:
    """Adds seq, the place of each row in the file, from 0.

    Rows are numbered within their row of tiles; the rows' first numbers are a running sum over one
    number a row of tiles.
    """
    return _running(tiles.withColumn("one", F.lit(1).cast("long")), "one", "seq").drop("one")


def _running(rows: DataFrame, what: str, name: str, total: str | None = None) -> DataFrame:
    """Adds name: the sum of ``what`` over the rows before, in file order; and total: the sum over all."""
    lines = rows.groupBy("level", "tile_row").agg(F.sum(what).alias("__sum"))
    before = Window.orderBy(F.desc("level"), "tile_row").rowsBetween(Window.unboundedPreceding, -1)
    # One row a row of tiles: an image of 10**8 pixels in height has 2 * 10**5.
    every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = [] if total is None else [F.sum("__sum").over(every).alias(total)]
    starts = lines.select("level", "tile_row", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"), *whole)
    inside = Window.partitionBy("level", "tile_row").orderBy("tile_col", "is_mask").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, ["level", "tile_row"]).withColumn(name, (F.col("__start") + F.coalesce(F.sum(what).over(inside), F.lit(0))).cast("long"))
    return out.select(*rows.columns, name, *([] if total is None else [total]))


def offsets(index: DataFrame, header_length: int | Column = 0, ghost: bool = False) -> DataFrame:
    """Adds off, where each tile's data begins in the file (after its leader, if blocks have them)."""
    extra = LEADER + TRAILER if ghost else 0
    sized = index.where("nbytes > 0").withColumn("__bytes", (F.col("nbytes") + extra).cast("long"))
    start = header_length if isinstance(header_length, Column) else F.lit(header_length)
    out = _running(sized, "__bytes", "off")
    return out.withColumn("off", (F.col("off") + start + (LEADER if ghost else 0)).cast("long")).drop("__bytes")


def with_sparse(sizes: DataFrame, placed: DataFrame) -> DataFrame:
    """off and nbytes of every tile of whole grids, image and mask (sizes: level, rows, cols); zero for absent ones.

    Only placed tiles and one row for each run of RUN places are exchanged and sorted: each spells out itself and
    the absent places up to the next.
    """
    place, last = F.col("tile_col").cast("long") * 2 + F.col("is_mask").cast("long"), F.col("cols").cast("long") * 2 - 1
    run = lambda c: F.call_function("div", c, F.lit(RUN).cast("long"))
    heads = sizes.where("rows > 0 AND cols > 0").withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)))
    heads = heads.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), run(last))))
    nothing = F.lit(None)
    heads = heads.select("level", "tile_row", "cols", "__run", (F.col("__run") * RUN).alias("__at"), nothing.cast("long").alias("off"), nothing.cast("int").alias("nbytes"), F.lit(False).alias("__real"))
    real = placed.join(F.broadcast(sizes), "level").where("tile_row >= 0 AND tile_row < rows AND tile_col >= 0 AND tile_col < cols AND is_mask IS NOT NULL")
    real = real.select("level", "tile_row", "cols", run(place).alias("__run"), place.alias("__at"), F.col("off").cast("long").alias("off"), F.col("nbytes").cast("int").alias("nbytes"), F.lit(True).alias("__real"))
    inside = Window.partitionBy("level", "tile_row", "__run").orderBy("__at", "__real")
    end = F.least((F.col("__run") + 1) * RUN, last + 1)
    spelt = heads.unionByName(real).withColumn("__next", F.coalesce(F.lead("__at").over(inside), end))
    # A run's first row is not a tile; a placed tile is there even if another has its place.
    stop = F.when(F.col("__real"), F.greatest(F.col("__next") - 1, F.col("__at"))).when(F.col("__next") > F.col("__at"), F.col("__next") - 1)
    spelt = spelt.withColumn("__stop", stop).where("__stop IS NOT NULL").withColumn("__p", F.explode(F.sequence("__at", "__stop")))
    own = F.col("__real") & (F.col("__p") == F.col("__at"))
    return spelt.select(
        "level", "tile_row", F.call_function("shiftright", F.col("__p"), F.lit(1)).cast("int").alias("tile_col"), (F.col("__p") % 2 == 1).alias("is_mask"),
        F.when(own, F.coalesce("off", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("off"), F.when(own, F.coalesce("nbytes", F.lit(0))).otherwise(F.lit(0)).alias("nbytes"),
    )


def directory_pairs(placed: DataFrame) -> DataFrame:
    """One row a level: the image's and the mask's tiles, bytes and first offset, aligned; nulls where one is missing."""

    def plane(is_mask: bool, stem: str) -> DataFrame:
        rows = placed.where(F.col("is_mask") == is_mask).groupBy("level")
        return rows.agg(F.count(F.lit(1)).alias(f"{stem}_tiles"), F.sum("nbytes").cast("long").alias(f"{stem}_bytes"), F.min("off").alias(f"{stem}_first"))

    return plane(False, "image").join(plane(True, "mask"), "level", "full_outer")


def groups(tiles: DataFrame, count: int = MAX_PARTS) -> DataFrame:
    """Adds grp: at most count runs of tiles that follow each other in the file, of nearly equal numbers, the
    longer ones first.  Tiles have numbers in file order, of which the group is arithmetic."""
    numbered = _running(tiles.withColumn("__one", F.lit(1).cast("long")), "__one", "__at", "__n")
    div = lambda a, b: F.call_function("div", a, b)
    at, size, longer = F.col("__at"), div(F.col("__n"), F.lit(count)), F.col("__n") % count
    ahead = longer * (size + 1)
    grp = F.when(at < ahead, div(at, size + 1)).otherwise(longer + div(at - ahead, F.greatest(size, F.lit(1))))
    return numbered.select(*tiles.columns, (grp + 1).cast("int").alias("grp"))


def part_size(total: int, least: int = MIN_PART) -> int:
    """Bytes of a part, so that no file has more than MAX_PARTS and only the last is shorter."""
    size = max(least, -(-total // MAX_PARTS))
    if total > MAX_FILE or size > MAX_PART:
        raise ValueError(f"a file of {total} bytes is beyond the limits of multipart uploads")
    return size


def part_slices(pieces: DataFrame, part_bytes: int) -> DataFrame:
    """Cuts pieces of a file (off, nbytes and what else they have) at the borders of parts: part_no from 1,
    at (the place in the part), skip and take (what of the piece)."""
    size = F.lit(part_bytes).cast("long")
    div = lambda a: F.call_function("div", a, size)
    out = pieces.where("nbytes > 0").withColumn("part", F.explode(F.sequence(div(F.col("off")), div(F.col("off") + F.col("nbytes") - 1))))
    start = F.greatest(F.col("off"), F.col("part") * size)
    stop = F.least(F.col("off") + F.col("nbytes"), (F.col("part") + 1) * size)
    return out.select(*pieces.columns, (F.col("part") + 1).cast("int").alias("part_no"), (start - F.col("part") * size).cast("long").alias("at"), (start - F.col("off")).cast("long").alias("skip"), (stop - start).cast("long").alias("take"))


def part_plan(slices: DataFrame) -> DataFrame:
    """part_no, pieces and nbytes of each part."""
    return slices.groupBy("part_no").agg(F.count(F.lit(1)).alias("pieces"), F.sum("take").cast("long").alias("nbytes"))
