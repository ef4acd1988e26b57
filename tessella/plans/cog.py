"""From a raster to a cloud-optimised GeoTIFF.

1. Levels: each overview is made from the one before and written to the shared folder, once.
2. Encoding: tiles become compressed blocks, also written there once; blocks without content are left out.
3. Layout: offsets are running sums over the sizes of the blocks (no pixel data moves for that).
4. Header: directories on the driver; the arrays of tile offsets as rows, made by tasks.
5. Parts: header, arrays and blocks are cut at the borders of equal parts; one exchange brings the
   pieces of each part together, and tasks write parts in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import halved, overview_levels
from ..functions.options import CogOptions
from ..operators.layout import MIN_PART, TRAILER, offsets, part_size, part_slices
from ..operators.pixels import STATISTICS
from ..operators.tiles import TILES, Raster, _filler, band_stats, batch_of, overview, unpacked
from ..session import bounded_batches, written
from ..sources.codecs import differenced, encoded
from ..sources.multipart import Store, resolved
from ..sources.sink import PARTS, write_parts
from ..sources.tiff import Spec, TileArrays, header

BLOCKS = "level int, tile_row int, tile_col int, is_mask boolean, nbytes int, data binary"


def levels(raster: Raster, kernel: str, count: int | None = None, stage: bool = True) -> list[Raster]:
    """The raster and its overviews.  stage: the raster's own tiles are written to the shared folder first,
    which spares computing them again for each of their uses."""
    n = overview_levels(raster.width, raster.height, raster.blocksize, count)
    out = [replace(raster, tiles=written(raster.tiles, "level0")) if stage else raster]
    for level in range(1, n + 1):
        over = overview(out[-1], kernel)
        out.append(replace(over, tiles=written(over.tiles, f"level{level}")))
    return out


def blocks(raster: Raster, options: CogOptions) -> DataFrame:
    """The encoded blocks of a level: pixels interleaved by band, and the mask as bits.  Blocks of nothing
    but the filler, and masks of nothing, are left out if the options allow it."""
    b, bands, dtype, has_mask = raster.blocksize, raster.bands, raster.dtype, raster.has_mask
    codec, predictor, level = (options.compress, options.predictor, options.level) if raster.level == 0 else (options.overview_compress, options.overview_predictor, options.overview_level)
    fill, sparse = _filler(raster.nodata, dtype), options.sparse_ok
    kind = np.dtype(dtype).newbyteorder("<")
    bounded_batches(raster.tiles.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                h, w, at = row["height"], row["width"], (row["level"], row["tile_row"], row["tile_col"])
                block = np.full((b, b, bands), fill, kind)
                block[:h, :w] = unpacked(row["payload"], bands, h, w, dtype).transpose(1, 2, 0)
                empty = np.isnan(block).all() if fill != fill else (block == fill).all()
                if not (sparse and empty):
                    data = encoded(differenced(block, predictor), codec, level)
                    rows.append((*at, False, len(data), data))
                if has_mask:
                    bits = np.zeros((b, b), np.uint8)
                    bits[:h, :w] = 1 if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(h, w) != 0
                    if not sparse or bits.any():
                        data = encoded(np.packbits(bits).tobytes(), "deflate")
                        rows.append((*at, True, len(data), data))
            yield batch_of(rows, BLOCKS)

    return raster.tiles.mapInArrow(run, BLOCKS)


def completed(raster: Raster) -> Raster:
    """The raster with a tile of fillers, outside the mask, for each that is absent: for files without sparse blocks."""
    spark, b = raster.tiles.sparkSession, raster.blocksize
    rows, cols, bands, dtype, level, has_mask = raster.tile_rows, raster.tile_cols, raster.bands, raster.dtype, raster.level, raster.has_mask
    high, wide, fill = raster.height, raster.width, _filler(raster.nodata, raster.dtype)
    grid = spark.range(rows * cols).select(F.expr(f"id div {cols}").cast("int").alias("tile_row"), (F.col("id") % cols).cast("int").alias("tile_col"))
    absent = grid.join(raster.tiles.select("tile_row", "tile_col"), ["tile_row", "tile_col"], "left_anti")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w = min(b, high - row["tile_row"] * b), min(b, wide - row["tile_col"] * b)
                data = np.full((bands, h, w), fill, np.dtype(dtype).newbyteorder("<")).tobytes()
                yield batch_of([(level, row["tile_row"], row["tile_col"], h, w, data, bytes(h * w) if has_mask else None)], TILES)

    return replace(raster, tiles=raster.tiles.unionByName(absent.mapInArrow(run, TILES)))


def tags_with_stats(meta: Mapping[str, Any], stats: DataFrame) -> dict[str, Any]:
    """meta with the statistics among the tags of its bands (a row a band comes to the driver)."""
    tags = {int(k): dict(v) for k, v in meta.get("update_tags", {}).items()}
    for row in stats.collect():
        own = tags.setdefault(row.band, {})
        if row.valid_percent > 0:
            own.update({f"STATISTICS_{name}": value for name, value in zip(STATISTICS[:4], (row.max, row.mean, row.min, row.std), strict=True)})
        own[f"STATISTICS_{STATISTICS[4]}"] = row.valid_percent
    return {**meta, "update_tags": tags}


@dataclass(frozen=True)
class Plan:
    """A file: its pieces (off, nbytes, layer, data), its length, and the blocks' places."""

    pieces: DataFrame
    total: int
    header_length: int
    placed: DataFrame
    levels: list[Raster]

    def parts(self, part_bytes: int) -> DataFrame:
        """Rows for the sink.  Every part has one, also where a part is nothing but zeros."""
        spark = self.pieces.sparkSession
        cut = part_slices(self.pieces, part_bytes)
        rows = cut.select("part_no", "layer", "at", F.expr("substring(data, cast(skip + 1 as int), cast(take as int))").alias("data"))
        every = spark.range(1, -(-self.total // part_bytes) + 1).select(F.col("id").cast("int").alias("part_no"), F.lit(-1).alias("layer"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("data"))
        return rows.unionByName(every).select(*(x.split()[0] for x in PARTS.split(", ")))


def _array_pieces(placed: DataFrame, places: list[TileArrays]) -> DataFrame:
    """The contents of the tile arrays, a piece for each row of tiles; absent tiles are zeros, which need no piece."""
    spark = placed.sparkSession
    # A row a page: at most 62 levels, twice.
    pages = spark.createDataFrame([(p.level, p.is_mask, p.tile_cols, p.offsets_at, p.offset_size, p.counts_at, p.count_size) for p in places], "level int, is_mask boolean, cols int, offsets_at long, offset_size int, counts_at long, count_size int")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        row = key[2].as_py()
        cols, offsets_at, offset_size, counts_at, count_size = (group.column(c)[0].as_py() for c in ("cols", "offsets_at", "offset_size", "counts_at", "count_size"))
        out = []
        for name, at, size in (("off", offsets_at, offset_size), ("nbytes", counts_at, count_size)):
            values = np.zeros(cols, f"<u{size}")
            values[group.column("tile_col").to_numpy()] = group.column(name).to_numpy()
            out.append((at + row * cols * size, cols * size, 1, values.tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["off", "nbytes", "layer", "data"])

    return placed.join(F.broadcast(pages), ["level", "is_mask"]).groupBy("level", "is_mask", "tile_row").applyInArrow(run, "off long, nbytes long, layer int, data binary")


def planned(raster: Raster, options: CogOptions, stage: bool = True) -> Plan:
    """Everything but the writing."""
    if raster.blocksize != options.blocksize:
        raise ValueError(f"tiles of {raster.blocksize} pixels, but blocksize {options.blocksize}")
    if options.nodata is not None and raster.nodata is None:
        raster = replace(raster, nodata=options.nodata)
    all_levels = levels(raster, options.kernel, options.overview_count, stage)
    meta = options.meta
    if options.statistics:
        meta = tags_with_stats(meta, band_stats(all_levels[0]))
    found = None
    for one in all_levels:
        made = blocks(one if options.sparse_ok else completed(one), options)
        found = made if found is None else found.unionByName(made)
    data = written(found, "blocks")
    spec = Spec(
        tuple((halved(raster.height, k), halved(raster.width, k)) for k in range(len(all_levels))), raster.bands, raster.dtype, raster.blocksize, raster.has_mask,
        options.compress, options.predictor, options.overview_compress, options.overview_predictor,
        raster.nodata, options.transform, options.crs, options.geotiff_version, meta, options.ghost, options.bigtiff,
    )
    front, length, places = header(spec)
    placed = written(offsets(data.drop("data"), length, options.ghost), "places")
    extra = 2 * TRAILER if options.ghost else 0
    body = placed.agg(F.sum(F.col("nbytes").cast("long") + extra).alias("n")).first().n or 0
    by = ["level", "tile_row", "tile_col", "is_mask"]
    bytes_ = data.join(placed.select(*by, "off"), by)
    if options.ghost:
        # The block's length before it, little-endian, and its last four bytes again after it.
        size = F.reverse(F.unhex(F.lpad(F.hex("nbytes"), 8, "0")))
        again = F.expr("CASE WHEN nbytes >= 4 THEN substring(data, -4, 4) ELSE lpad(data, 4, X'00') END")
        body_rows = bytes_.select((F.col("off") - TRAILER).alias("off"), (F.col("nbytes").cast("long") + extra).alias("nbytes"), F.lit(0).alias("layer"), F.concat(size, "data", again).alias("data"))
    else:
        body_rows = bytes_.select("off", F.col("nbytes").cast("long").alias("nbytes"), F.lit(0).alias("layer"), "data")
    spark = raster.tiles.sparkSession
    first = spark.createDataFrame([(0, len(front), 0, bytearray(front))], "off long, nbytes long, layer int, data binary")
    pieces = first.unionByName(_array_pieces(placed, places)).unionByName(body_rows)
    return Plan(pieces, length + body, length, placed, all_levels)


def write_cog(raster: Raster, store: str | Store | None = None, options: Mapping[str, Any] | None = None, storage_options: Mapping[str, Any] | None = None, mask: Any = None, part_bytes: int | None = None, stage: bool = True) -> bytes | str | Store:
    """Writes a raster with its overviews, and returns where it is; without a store, returns its bytes.

    options: see functions.options; overview_resampling is required.  A mask that isn't in the
    raster's tiles is an array of the image's size.  part_bytes: 5 MiB or what 10,000 parts need.
    """
    own = CogOptions.of(options or {})
    if mask is not None:
        raster = with_mask(raster, mask)
    plan = planned(raster, own, stage)
    size = part_size(plan.total) if part_bytes is None else part_bytes
    if store is None:
        rows = plan.parts(size).orderBy("part_no", "layer", "at")
        out = bytearray(plan.total)
        # The caller wants the whole file in this process, so it has to fit here.
        for row in rows.toLocalIterator():
            start = (row.part_no - 1) * size + row.at
            out[start : start + len(row.data)] = row.data
        return bytes(out)
    target = resolved(store, dict(storage_options or {}))
    write_parts(plan.parts(size), target, max(size, MIN_PART) if part_bytes is None else size, plan.total)
    return store


def with_mask(raster: Raster, mask: np.ndarray) -> Raster:
    """The raster with a mask that the driver has as an array; non-zero is valid."""
    mask = np.asarray(mask)
    if mask.shape != (raster.height, raster.width):
        raise ValueError("the mask must have the image's height and width")
    from ..operators.tiles import from_array

    spark = raster.tiles.sparkSession
    other = from_array(spark, (mask != 0).astype(np.uint8), blocksize=raster.blocksize).tiles.select("tile_row", "tile_col", F.col("payload").alias("mask"))
    tiles = raster.tiles.drop("mask").join(other, ["tile_row", "tile_col"], "left").select(*(x.split()[0] for x in TILES.split(", ")))
    return replace(raster, tiles=tiles, has_mask=True)
