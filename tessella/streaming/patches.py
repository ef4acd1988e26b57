"""Patches of a raster: changed tiles replace old ones, and of the overviews only their ancestors are made again.

A patch reaches the tiles above it, and for kernels with a halo also their neighbours.  Which tiles those
are is arithmetic on the patch's tile numbers; the source tiles that they need are found by semi joins
with that short list, so the rest of the raster is neither read by the kernels nor moved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grid import halved, tile_count
from ..functions.kernels import HALO
from ..operators.tiles import TILES, Raster, overview

KEYS = ["tile_row", "tile_col"]


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the tiles of new in place of its own."""
    names = [x.split()[0] for x in TILES.split(", ")]
    return old.join(new.select(*KEYS), KEYS, "left_anti").select(*names).unionByName(new.select(*names))


def touched(changed: DataFrame, raster: Raster, kernel: str) -> DataFrame:
    """The tiles of the next level that read the changed tiles (tile_row, tile_col) of raster."""
    b, halo = raster.blocksize, HALO[kernel]
    rows, cols = tile_count(halved(raster.height), b), tile_count(halved(raster.width), b)

    def parents(name: str, most: int):
        low = F.floor((F.col(name) * b - halo) / (2 * b))
        high = F.floor((F.col(name) * b + b - 1 + halo) / (2 * b))
        return F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), F.least(F.lit(most - 1).cast("long"), F.greatest(F.lit(0).cast("long"), high))))

    # An odd end may lie beyond the last tile above; the last one may read it.
    near = changed.select(parents("tile_row", rows).alias("tile_row"), "tile_col").select("tile_row", parents("tile_col", cols).alias("tile_col"))
    return near.select(F.col("tile_row").cast("int").alias("tile_row"), F.col("tile_col").cast("int").alias("tile_col")).distinct()


def needed(parents: DataFrame, raster: Raster, kernel: str) -> DataFrame:
    """The tiles of raster that the given tiles of the next level read."""
    b, halo = raster.blocksize, HALO[kernel]
    reach = 1 if halo else 0
    assert halo <= b

    def children(name: str, most: int):
        low, high = F.greatest(F.lit(0), F.col(name) * 2 - reach), F.least(F.lit(most - 1), F.col(name) * 2 + 1 + reach)
        return F.explode(F.sequence(low, high))

    near = parents.select(children("tile_row", raster.tile_rows).alias("tile_row"), "tile_col").select("tile_row", children("tile_col", raster.tile_cols).alias("tile_col"))
    return near.distinct()


def patched(raster: Raster, above: Raster, patch: Raster, kernel: str) -> tuple[Raster, Raster]:
    """The raster and the level above it after a patch (tiles of raster's level)."""
    base = replace(raster, tiles=replaced(raster.tiles, patch.tiles))
    parents = touched(patch.tiles.select(*KEYS), raster, kernel)
    source = base.tiles.join(needed(parents, raster, kernel), KEYS, "left_semi")
    made = overview(replace(base, tiles=source), kernel).tiles.join(parents, KEYS, "left_semi")
    return base, replace(above, tiles=replaced(above.tiles, made))


def patch_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls apply(latest tiles, batch number) for each batch of a stream of tiles that has arrived.

    stream: tiles and seq, a number that grows.  Of several versions of a tile in a batch the latest
    counts.  A batch may be given again after a failure, so apply should write its result under the
    batch's number.
    """
    names = [x.split()[0] for x in TILES.split(", ")]

    def run(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("level", *KEYS).agg(F.max_by(F.struct(*names), "seq").alias("tile")).select("tile.*")
        apply(latest, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
