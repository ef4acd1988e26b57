"""The registered queries of the raster operators, and the same in DuckDB's SQL.

Rasters are made of the tables: G (embeddings: a row of the image per vector, one column per
dimension, whole numbers), E (events: counts by hour and user, a band per event type) and H (lineitem:
quantities by supplier and part, very sparse).
"""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import grid, options
from .functions.kernels import HALO, taps
from .operators import layout, pixels, resample, tiles
from .plans.cog import write_cog
from .session import shared_path
from .sources.arrays import from_chunks
from .sources.reader import read_cog
from .streaming.patches import patched

BLOCK = 16
LEVELS = 3
#: Rows of a table that a task holds at once.
TASK_ROWS = 1 << 18


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rasters.


def raster_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor(F.col("x").cast("double") * 1000).cast("int")
    return pixels.from_arrays(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", value)


def size_g(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Height and width, from one row of aggregates."""
    row = _table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
    return row[0], row[1]


def mask_g(cells: DataFrame) -> DataFrame:
    return cells.select("r", "c", ((F.col("r") * 7 + F.col("c") * 3) % 11 != 0).alias("valid"))


def masked_g(spark: SparkSession, sf_dir: str, mask: bool = True, nodata: bool = True) -> DataFrame:
    cells = raster_g(spark, sf_dir)
    return pixels.masked(cells, mask_g(cells) if mask else None, 0 if nodata else None)


def raster_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    # A row an event type: a handful.
    kinds = events.select("event_type").distinct().withColumn("band", F.row_number().over(Window.orderBy("event_type")))
    cells = events.groupBy("event_type", F.hour("ts").alias("r"), F.col("user_id").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("v"))
    return cells.join(F.broadcast(kinds), "event_type").select("band", "r", "c", "v")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of images to be: id, width, height, blocksize, count (of overviews; null: automatic)."""
    part = _table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        (F.col("p_partkey") * 5 + 1).alias("width"),
        (F.col("p_size") * 40).cast("long").alias("height"),
        F.when(F.col("p_partkey") % 2 == 0, 256).otherwise(512).alias("blocksize"),
        F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 7).cast("int")).alias("count"),
    )


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = images(spark, sf_dir).withColumn("levels", grid.overview_levels_column(F.col("width"), F.col("height"), F.col("blocksize"), F.col("count")))
    return grid.level_dims(some)


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, blocksize and the sizes of an axis's chunks."""
    some = _table(spark, sf_dir, "part")
    length, chunk = (F.col("p_partkey") * 37 % 1000 + 1).cast("long"), (F.lit(16) + F.col("p_size") % 5 * 8).cast("long")
    return some.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, 16).otherwise(32).cast("long").alias("blocksize"), grid.chunk_sizes(length, chunk).alias("sizes"))


def index_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three levels of H, with the sizes that a row of eight bytes a pixel would give; a mask block each, some empty.

    All blocks of an area of the smallest level are made in one task, so that pixels are exchanged once, and there
    are as many tasks as rows need: what one of them holds doesn't grow with the tables.
    """
    items = _table(spark, sf_dir, "lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // TASK_ROWS))
    # Blocks on both sides of zero overlap those of other levels, so what is below it is one area with the first.
    area = lambda c: F.greatest(F.call_function("div", F.call_function("shiftright", F.col(c), F.lit(LEVELS - 1)), F.lit(BLOCK)), F.lit(0).cast("long"))
    cells = items.select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).select("r", "c", area("r").alias("__down"), area("c").alias("__across"))
    cells = cells.repartition(tasks, "__down", "__across").distinct()
    cells = cells.select("*", F.explode(F.array(*map(F.lit, range(LEVELS)))).alias("level"))
    at = lambda c: F.call_function("div", F.call_function("shiftright", F.col(c), F.col("level")), F.lit(BLOCK)).cast("int")
    by = cells.groupBy("__down", "__across", "level", at("r").alias("tile_row"), at("c").alias("tile_col")).agg(F.count(F.lit(1)).alias("n"))
    planes = F.array(F.struct(F.lit(False).alias("is_mask"), (F.col("n") * 8).cast("int").alias("nbytes")), F.struct(F.lit(True).alias("is_mask"), (F.col("n") % 5).cast("int").alias("nbytes")))
    return by.select("level", "tile_row", "tile_col", F.inline(planes))


# Scans and tiles.


def raster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster_g(spark, sf_dir)


def raster_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_g(spark, sf_dir)


def raster_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raster from chunks of rows that tasks read from the file themselves."""
    high, wide = size_g(spark, sf_dir)
    path = f"{sf_dir}/embeddings.parquet"

    def fetch(top: int, bottom: int, left: int, right: int) -> np.ndarray:
        import pyarrow.fs as pafs

        system, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        rows = ds.dataset(inside, filesystem=system).to_table(["vec_id", "embedding"], (ds.field("vec_id") >= top) & (ds.field("vec_id") < bottom)).sort_by("vec_id")
        cells = rows.column("embedding").combine_chunks().flatten().to_numpy().reshape(bottom - top, -1)
        return np.floor(cells[:, left:right].astype(np.float64) * 1000).astype(np.int32)

    rows = tuple(min(4 * BLOCK, high - a) for a in range(0, high, 4 * BLOCK))
    made = from_chunks(spark, fetch, (rows, (wide,)), "int32", BLOCK)
    return tiles.to_pixels(made).select("band", "r", "c", F.col("v").cast("int").alias("v"))


def tile_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pixels.in_tiles(raster_g(spark, sf_dir), BLOCK)
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    by = cells.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), ordered.alias("cells"))
    spelt = F.array_join(F.transform("cells", lambda s: s["v"].cast("string")), ",")
    return by.select("tile_row", "tile_col", "n", "total", F.sha2(spelt, 256).alias("sha256"))


def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_h(spark, sf_dir).where("nbytes > 0")


# Grids and options.


def overview_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = images(spark, sf_dir)
    return some.select("id", grid.overview_levels_column(F.col("width"), F.col("height"), F.col("blocksize"), F.col("count")).alias("levels"))


def level_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leveled(spark, sf_dir).select("id", "level", "level_width", "level_height")


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tile_grid(leveled(spark, sf_dir)).select("id", "level", "tile_row", "tile_col", "tile_height", "tile_width")


def ifd_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.ifd_types(leveled(spark, sf_dir)).select("id", "level", "width_type", "height_type", "n_tiles", "count_type")


def unoverlap_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, wide = size_g(spark, sf_dir)
    rows, cols = grid.tile_count(high, BLOCK), grid.tile_count(wide, BLOCK)
    kernels = spark.createDataFrame(list(HALO.items()), "kernel string, halo int")
    chunks = spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("chunk_row"), (F.col("id") % cols).cast("int").alias("chunk_col"), F.lit(rows).alias("chunk_rows"), F.lit(cols).alias("chunk_cols"))
    # Nine kernels for every chunk.
    out = chunks.withColumn("kernel", F.explode(F.array(*map(F.lit, HALO)))).join(F.broadcast(kernels), "kernel")
    return grid.halo_trims(out).select("kernel", "chunk_row", "chunk_col", "top", "bottom", "left", "right")


def chunk_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("id", F.posexplode(grid.merged_edge(F.col("sizes"))).alias("pos", "size"))


def chunk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("sizes")
    return chunked(spark, sf_dir).select("id", grid.interior_multiple(size, F.col("blocksize")).alias("aligned"), (grid.interior_equal(size, F.col("blocksize")) | (F.size(size) == 1)).alias("row_major"))


def option_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of options of many jobs, from events: a user's events in order are layers."""
    # A cycle of option names and values for the fixture.
    names = ["Driver", "BLOCKSIZE", "warp_resampling", "Overview_Resampling", "compress", "OVERVIEW_COMPRESS", "quality", "Predictor", "overview_quality", "resampling", "nodata"]
    values = ["cog", "512", "cubic", "Average", "deflate", "ZSTD", "75", "standard", "50", "sinc", "-9999"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") * 7 % len(xs) + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("layer"), pick(names).alias("key"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(pick(values)).alias("value"))


def option_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.overlay_rows(option_rows(spark, sf_dir))


def option_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.refused_rows(option_rows(spark, sf_dir))


def option_overview_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options.overview_rows(options.overlay_rows(option_rows(spark, sf_dir)))


# Statistics.


def stats_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.band_stats(pixels.masked(raster_e(spark, sf_dir)))


def _tiles_of_g(spark: SparkSession, sf_dir: str, mask: bool, nodata: bool) -> tiles.Raster:
    high, wide = size_g(spark, sf_dir)
    cells = raster_g(spark, sf_dir)
    if mask:
        cells = pixels.masked(cells, mask_g(cells))
    return tiles.from_pixels(cells, high, wide, 1, "int32", BLOCK, 0 if nodata else None)


def stats_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.band_stats(_tiles_of_g(spark, sf_dir, False, True))


def stats_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.band_stats(_tiles_of_g(spark, sf_dir, True, False))


def stats_nodata_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.band_stats(masked_g(spark, sf_dir))


def stats_uint32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels near the end of their type, whose squares need all of 64 bits."""
    high, wide = size_g(spark, sf_dir)
    cells = raster_g(spark, sf_dir).withColumn("v", F.lit(4294966000) + F.col("v"))
    return tiles.band_stats(tiles.from_pixels(cells, high, wide, 1, "uint32", BLOCK))


def stats_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.stats_tags(stats_band(spark, sf_dir))


# Overviews: over pixels, with values as they come; over tiles, rounded to the pixels' type.


def _overview(kernel: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return resample.overview(raster_g(spark, sf_dir), kernel, *size_g(spark, sf_dir))

    query.__name__ = f"overview_{kernel}"
    return query


def _tiles_overview(kernel: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = tiles.overview(_tiles_of_g(spark, sf_dir, True, True), kernel)
        return tiles.to_pixels(made).select("band", "r", "c", "v")

    query.__name__ = f"tiles_{kernel}"
    return query


def overview_odd_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Odd sides: an even image goes without its last row or column.
    high, wide = (n - 1 + n % 2 for n in size_g(spark, sf_dir))
    cells = masked_g(spark, sf_dir).where(F.col("valid") & (F.col("r") < high) & (F.col("c") < wide)).select("band", "r", "c", "v")
    return resample.overview(cells, "bilinear", high, wide)


def halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = pixels.halo_rows(raster_g(spark, sf_dir), BLOCK, HALO["bilinear"])
    return sent.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own"), F.sum("v").alias("total"))


def pyramid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.pyramid(raster_g(spark, sf_dir), "average", *size_g(spark, sf_dir), LEVELS)


# Layout.


def sparse_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_h(spark, sf_dir)
    sizes = index.groupBy("level").agg((F.max("tile_row") + 1).alias("rows"), (F.max("tile_col") + 1).alias("cols"))
    return layout.with_sparse(sizes, layout.offsets(index, 1000))


def tile_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.file_order(index_h(spark, sf_dir)).select("level", "tile_row", "tile_col", "is_mask", "seq")


def layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.offsets(index_h(spark, sf_dir), 1000)


def layout_ghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.offsets(index_h(spark, sf_dir), 1000, ghost=True)


def ifd_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.directory_pairs(layout.offsets(index_h(spark, sf_dir).where("level > 0 OR NOT is_mask"), 1000))


def mpu_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_h(spark, sf_dir).where("nbytes > 0")
    return layout.groups(index, 100).select("level", "tile_row", "tile_col", "is_mask", "grp")


def mpu_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.part_plan(layout.part_slices(layout.offsets(index_h(spark, sf_dir)), 5000))


# Files.


def _written(spark: SparkSession, raster: tiles.Raster, **more) -> str:
    path = urlparse(f"{shared_path(spark, 'cog')}/image.tif").path
    write_cog(raster, path, {"overview_resampling": "average", "blocksize": BLOCK, "overview_count": LEVELS, **more}, part_bytes=1 << 16)
    return path


def cog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _tiles_of_g(spark, sf_dir, True, False), compress="zstd", predictor=2)
    return tiles.to_pixels(read_cog(spark, path), only_valid=False).select("band", "r", "c", F.col("v").cast("int").alias("v"))


def cog_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _tiles_of_g(spark, sf_dir, False, False), cog_ghost_data=False)
    out = None
    for level in range(LEVELS + 1):
        one = tiles.to_pixels(read_cog(spark, path, level)).select(F.lit(level).alias("level"), "band", "r", "c", F.col("v").cast("int").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def cog_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _tiles_of_g(spark, sf_dir, False, False), compress="none")
    found = tiles.to_pixels(read_cog(spark, path, 0, (40, 20, 90, 40)))
    return found.where("r BETWEEN 40 AND 90 AND c BETWEEN 20 AND 40").select("band", "r", "c", F.col("v").cast("int").alias("v"))


def tile_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average pyramid after a patch, of which only the patch's ancestors are made again."""
    whole = _tiles_of_g(spark, sf_dir, False, False)
    base = raster_g(spark, sf_dir)
    change = base.where("r < 16 AND c >= 16 AND c < 32").select("band", "r", "c", (F.col("v") + 1000).alias("v"))
    patch = tiles.from_pixels(change, whole.height, whole.width, 1, "int32", BLOCK)
    made = patched(whole, tiles.overview(whole, "average"), patch, "average")
    return tiles.to_pixels(made[1]).select("band", "r", "c", "v")


_NAMED = [
    raster_scan, raster_mask, raster_chunks, tile_split, tile_index,
    overview_levels, level_dims, tile_grid, ifd_types, unoverlap_slices, chunk_adjust, chunk_validate, option_overlay, option_refusals, option_overview_codec,
    stats_band, stats_nodata, stats_mask, stats_nodata_mask, stats_uint32, stats_tags,
    *map(_overview, HALO), *map(_tiles_overview, HALO), overview_odd_edge, halo_exchange, pyramid_all,
    sparse_tiles, tile_order, layout_offsets, layout_ghost, ifd_align, mpu_ntile, mpu_plan,
    cog_roundtrip, cog_pyramid, cog_window, tile_patch,
]
QUERIES = {f.__name__: f for f in _NAMED}

# The oracle.

_G = "g AS (SELECT 1 AS band, CAST(vec_id AS INTEGER) AS r, CAST(i - 1 AS INTEGER) AS c, CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000) AS INTEGER) AS v FROM embeddings, range(1, 65) t(i))"
_OK = "(r * 7 + c * 3) % 11 <> 0"
_E = """k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS band FROM (SELECT DISTINCT event_type FROM events)),
        e AS (SELECT CAST(band AS INTEGER) AS band, CAST(hour(ts) AS INTEGER) AS r, CAST(user_id AS INTEGER) AS c, count(*) AS v FROM events JOIN k USING (event_type) GROUP BY ALL)"""
_IMAGES = """images AS (SELECT p_partkey AS id, p_partkey * 5 + 1 AS width, CAST(p_size AS BIGINT) * 40 AS height, CASE WHEN p_partkey % 2 = 0 THEN 256 ELSE 512 END AS blocksize,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 END AS n FROM part),
        counted AS (SELECT *, CASE WHEN n IS NULL THEN (SELECT count(*) FROM range(0, 63) t(k) WHERE (greatest(width, height) >> k) > blocksize)
                       ELSE least(n, (SELECT count(*) FROM range(0, 63) t(k) WHERE (greatest(width, height) >> k) > 1)) END AS levels FROM images),
        dims AS (SELECT id, blocksize, CAST(l AS INTEGER) AS level, greatest(1, width >> l) AS level_width, greatest(1, height >> l) AS level_height FROM (SELECT *, unnest(range(0, levels + 1)) AS l FROM counted))"""
_CHUNKS = """sized AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 16 ELSE 32 END AS blocksize, p_partkey * 37 % 1000 + 1 AS n, 16 + p_size % 5 * 8 AS chunk FROM part),
        chunks AS (SELECT id, blocksize, pos, least(chunk, n - pos * chunk) AS size, pos = (n - 1) // chunk AS edge FROM (SELECT *, unnest(range(0, (n - 1) // chunk + 1)) AS pos FROM sized))"""
_INDEX = f"""h AS (SELECT l_suppkey AS r, l_partkey AS c FROM lineitem GROUP BY ALL),
        blocks AS (SELECT CAST(l AS INTEGER) AS level, CAST((r >> l) // {BLOCK} AS INTEGER) AS tile_row, CAST((c >> l) // {BLOCK} AS INTEGER) AS tile_col, count(*) AS n FROM h, range(0, {LEVELS}) t(l) GROUP BY ALL),
        idx AS (SELECT level, tile_row, tile_col, false AS is_mask, CAST(n * 8 AS INTEGER) AS nbytes FROM blocks UNION ALL SELECT level, tile_row, tile_col, true, CAST(n % 5 AS INTEGER) FROM blocks)"""
_ORDER = "ORDER BY level DESC, tile_row, tile_col, is_mask"


def _placed(where: str = "true", header: int = 1000, extra: int = 0) -> str:
    return f"""placed AS (SELECT *, CAST({header} + {extra // 2} + coalesce(sum(nbytes + {extra}) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
        FROM idx WHERE nbytes > 0 AND {where})"""


_OPTIONS = """o AS (SELECT user_id AS job, event_id AS layer,
        ['Driver', 'BLOCKSIZE', 'warp_resampling', 'Overview_Resampling', 'compress', 'OVERVIEW_COMPRESS', 'quality', 'Predictor', 'overview_quality', 'resampling', 'nodata'][event_id * 7 % 11 + 1] AS key,
        CASE WHEN event_id % 5 = 0 THEN event_type ELSE ['cog', '512', 'cubic', 'Average', 'deflate', 'ZSTD', '75', 'standard', '50', 'sinc', '-9999'][event_id * 7 % 11 + 1] END AS value FROM events)"""
_CASELESS = ", ".join(f"'{x}'" for x in options.CASELESS)


def _overlaid(where: str) -> str:
    return f"over AS (SELECT job, lower(key) AS key, arg_max(CASE WHEN lower(key) IN ({_CASELESS}) THEN lower(value) ELSE value END, layer) AS value FROM o WHERE {where} GROUP BY ALL)"


def _stats(source: str, ok: str) -> str:
    n = f"count(*) FILTER ({ok})"
    v = f"FILTER ({ok})"
    return f"""SELECT band, CAST(max(v) {v} AS DOUBLE) AS max, CAST(sum(v) {v} AS DOUBLE) / nullif({n}, 0) AS mean, CAST(min(v) {v} AS DOUBLE) AS min,
        sqrt(CAST({n} * sum(CAST(v AS HUGEINT) * v) {v} - CAST(sum(v) {v} AS HUGEINT) * sum(v) {v} AS DOUBLE)) / nullif({n}, 0) AS std,
        100.0 * (1.0 - avg(CASE WHEN {ok} THEN 0 ELSE 1 END)) AS valid_percent FROM {source} GROUP BY band"""


def _sides(high: str, wide: str) -> str:
    return f"d AS (SELECT greatest(1, ({high}) // 2) AS h, greatest(1, ({wide}) // 2) AS w FROM (SELECT max(r) + 1 AS hh, max(c) + 1 AS ww FROM g))"


def _kernel(kernel: str, source: str = "s", name: str = "out", high: str = "hh", wide: str = "ww") -> str:
    """CTEs from source (band, r, c, v: valid pixels) to name."""
    sides = _sides(high, wide)
    owned = f"FROM {source}, d WHERE r < 2 * h AND c < 2 * w"
    if kernel == "nearest":
        return f"{sides}, {name} AS (SELECT band, r // 2 AS r, c // 2 AS c, v {owned} AND r % 2 = 0 AND c % 2 = 0)"
    if kernel == "average":
        return f"{sides}, {name} AS (SELECT band, r // 2 AS r, c // 2 AS c, avg(v) AS v {owned} GROUP BY ALL)"
    if kernel == "rms":
        return f"{sides}, {name} AS (SELECT band, r // 2 AS r, c // 2 AS c, sqrt(avg(CAST(v AS DOUBLE) * v)) AS v {owned} GROUP BY ALL)"
    if kernel == "mode":
        return f"""{sides}, seen AS (SELECT band, r // 2 AS r, c // 2 AS c, v, count(*) AS n {owned} GROUP BY ALL),
            {name} AS (SELECT band, r, c, v FROM seen QUALIFY row_number() OVER (PARTITION BY band, r, c ORDER BY n DESC, v) = 1)"""
    rows = ", ".join(f"({k}, {w})" for k, w in taps(kernel))
    return f"""{sides}, tap(k, wt) AS (VALUES {rows}),
        across AS (SELECT band, r, (c - k) // 2 AS c, sum(wt * v) AS nv, sum(wt) AS nw, bool_or(k IN (0, 1)) AS own FROM {source}, tap, d WHERE (c - k) % 2 = 0 AND c - k >= 0 AND c - k < 2 * w GROUP BY ALL),
        down AS (SELECT band, (r - k) // 2 AS r, c, sum(wt * nv) AS nv, sum(wt * nw) AS nw, bool_or(own AND k IN (0, 1)) AS own FROM across, tap, d WHERE (r - k) % 2 = 0 AND r - k >= 0 AND r - k < 2 * h GROUP BY ALL),
        {name} AS (SELECT band, r, c, CAST(nv AS DOUBLE) / CAST(nw AS DOUBLE) AS v FROM down WHERE own AND nw <> 0)"""


def _overview_sql(kernel: str) -> str:
    return f"WITH {_G}, {_kernel(kernel, 'g')} SELECT band, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM out"


def _tiles_sql(kernel: str) -> str:
    return f"WITH {_G}, s AS (SELECT * FROM g WHERE {_OK} AND v <> 0), {_kernel(kernel)} SELECT band, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(round(v) AS BIGINT) AS v FROM out WHERE round(v) <> 0"


def _pyramid(levels: int, source: str = "g") -> str:
    parts = [f"l0 AS (SELECT 0 AS level, band, r, c, v FROM {source}), dim AS (SELECT max(r) + 1 AS hh, max(c) + 1 AS ww FROM g)"]
    for k in range(1, levels + 1):
        parts.append(f"l{k} AS (SELECT {k} AS level, band, CAST(r // 2 AS INTEGER) AS r, CAST(c // 2 AS INTEGER) AS c, CAST(round(avg(v)) AS INTEGER) AS v FROM l{k - 1}, dim WHERE r < 2 * greatest(1, hh >> {k}) AND c < 2 * greatest(1, ww >> {k}) GROUP BY ALL)")
    return ", ".join(parts)


_ALL_LEVELS = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(LEVELS + 1))
_HALOS = ", ".join(f"('{k}', {h})" for k, h in HALO.items())
_REFUSED = ", ".join(f"'{x}'" for x in (*options.REFUSED, *options.REQUIRED))
_KERNELS = ", ".join(f"'{k}'" for k in HALO)
_SCAN = f"WITH {_G} SELECT band, r, c, v FROM g"

ORACLE_SQL = {
    "raster_scan": _SCAN,
    "raster_chunks": _SCAN,
    "raster_mask": f"WITH {_G} SELECT band, r, c, v, {_OK} AND v <> 0 AS valid FROM g",
    "tile_split": f"WITH {_G} SELECT CAST(r // {BLOCK} AS INTEGER) AS tile_row, CAST(c // {BLOCK} AS INTEGER) AS tile_col, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c)) AS sha256 FROM g GROUP BY ALL",
    "tile_index": f"WITH {_INDEX} SELECT * FROM idx WHERE nbytes > 0",
    "overview_levels": f"WITH {_IMAGES} SELECT id, CAST(levels AS INTEGER) AS levels FROM counted",
    "level_dims": f"WITH {_IMAGES} SELECT id, level, level_width, level_height FROM dims",
    "tile_grid": f"""WITH {_IMAGES}, rows AS (SELECT *, unnest(range(0, (level_height + blocksize - 1) // blocksize)) AS tile_row FROM dims),
        cells AS (SELECT *, unnest(range(0, (level_width + blocksize - 1) // blocksize)) AS tile_col FROM rows)
        SELECT id, level, tile_row, tile_col, CAST(least(blocksize, level_height - tile_row * blocksize) AS BIGINT) AS tile_height, CAST(least(blocksize, level_width - tile_col * blocksize) AS BIGINT) AS tile_width FROM cells""",
    "ifd_types": f"""WITH {_IMAGES}, n AS (SELECT *, CAST(((level_width + blocksize - 1) // blocksize) * ((level_height + blocksize - 1) // blocksize) AS BIGINT) AS n_tiles FROM dims)
        SELECT id, level, CASE WHEN level_width < 65536 THEN 'SHORT' ELSE 'LONG' END AS width_type, CASE WHEN level_height < 65536 THEN 'SHORT' ELSE 'LONG' END AS height_type, n_tiles, CASE WHEN n_tiles = 1 THEN 'LONG8' ELSE 'LONG' END AS count_type FROM n""",
    "unoverlap_slices": f"""WITH {_G}, ext AS (SELECT (max(r) + {BLOCK}) // {BLOCK} AS nr, (max(c) + {BLOCK}) // {BLOCK} AS nc FROM g), k(kernel, halo) AS (VALUES {_HALOS}),
        cells AS (SELECT kernel, halo, nr, nc, CAST(i // nc AS INTEGER) AS chunk_row, CAST(i % nc AS INTEGER) AS chunk_col FROM k, (SELECT nr, nc, unnest(range(0, nr * nc)) AS i FROM ext))
        SELECT kernel, chunk_row, chunk_col, CASE WHEN halo > 0 AND chunk_row > 0 THEN halo END AS top, CASE WHEN halo > 0 AND chunk_row < nr - 1 THEN -halo END AS bottom,
               CASE WHEN halo > 0 AND chunk_col > 0 THEN halo END AS "left", CASE WHEN halo > 0 AND chunk_col < nc - 1 THEN -halo END AS "right" FROM cells""",
    "chunk_adjust": f"""WITH {_CHUNKS}, thin AS (SELECT *, lead(size) OVER (PARTITION BY id ORDER BY pos) AS after, lead(edge) OVER (PARTITION BY id ORDER BY pos) AS after_edge FROM chunks)
        SELECT id, CAST(pos AS INTEGER) AS pos, CAST(size + CASE WHEN after_edge AND after <= {grid.THIN_CHUNK} THEN after ELSE 0 END AS BIGINT) AS size FROM thin WHERE NOT (edge AND pos > 0 AND size <= {grid.THIN_CHUNK})""",
    "chunk_validate": f"""WITH {_CHUNKS} SELECT id, coalesce(bool_and(size % blocksize = 0) FILTER (NOT edge), true) AS aligned, coalesce(bool_and(size = blocksize) FILTER (NOT edge), true) OR count(*) = 1 AS row_major FROM chunks GROUP BY id""",
    "option_overlay": f"WITH {_OPTIONS}, {_overlaid('true')} SELECT job, key, value FROM over",
    "option_refusals": f"""WITH {_OPTIONS}, j AS (SELECT job, lower(key) AS key, lower(value) AS value FROM o)
        SELECT job, count(DISTINCT key) FILTER (key IN ({_REFUSED})) AS n_refused,
               coalesce(coalesce(max(value) FILTER (key = 'overview_resampling'), max(value) FILTER (key = 'resampling')) IN ({_KERNELS}), false) AS resampling_ok FROM j GROUP BY job""",
    "option_overview_codec": f"""WITH {_OPTIONS}, {_overlaid('true')},
        wide AS (SELECT job, {', '.join(f"max(value) FILTER (key = '{n}') AS {n}" for k in ('compress', 'quality', 'predictor') for n in (k, f'overview_{k}'))} FROM over GROUP BY job),
        other AS (SELECT *, overview_compress IS NOT NULL AND overview_compress IS DISTINCT FROM compress AS own FROM wide)
        SELECT job, coalesce(overview_compress, compress) AS compress, coalesce(overview_quality, CASE WHEN NOT own THEN quality END) AS quality, coalesce(overview_predictor, CASE WHEN NOT own THEN predictor END) AS predictor FROM other""",
    "stats_band": f"WITH {_E} {_stats('e', 'true')}",
    "stats_nodata": f"WITH {_G} {_stats('g', 'v <> 0')}",
    "stats_mask": f"WITH {_G} {_stats('g', _OK)}",
    "stats_nodata_mask": f"WITH {_G} {_stats('g', f'{_OK} AND v <> 0')}",
    "stats_uint32": f"WITH {_G}, u AS (SELECT band, CAST(v AS BIGINT) + 4294966000 AS v FROM g) {_stats('u', 'true')}",
    "stats_tags": f"""WITH {_E}, s AS ({_stats('e', 'true')})
        SELECT band, 'STATISTICS_MAXIMUM' AS name, max AS value FROM s UNION ALL SELECT band, 'STATISTICS_MEAN', mean FROM s UNION ALL SELECT band, 'STATISTICS_MINIMUM', min FROM s
        UNION ALL SELECT band, 'STATISTICS_STDDEV', std FROM s UNION ALL SELECT band, 'STATISTICS_VALID_PERCENT', valid_percent FROM s""",
    **{f"overview_{k}": _overview_sql(k) for k in HALO},
    **{f"tiles_{k}": _tiles_sql(k) for k in HALO},
    "overview_odd_edge": f"WITH {_G}, s AS (SELECT * FROM g WHERE {_OK} AND v <> 0 AND r < 499 AND c < 63), {_kernel('bilinear', high='499', wide='63')} SELECT band, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM out",
    "halo_exchange": f"""WITH {_G}, t AS (SELECT DISTINCT r // {BLOCK} AS tile_row, c // {BLOCK} AS tile_col FROM g)
        SELECT CAST(tile_row AS INTEGER) AS tile_row, CAST(tile_col AS INTEGER) AS tile_col, count(*) AS n, count(*) FILTER (r // {BLOCK} = tile_row AND c // {BLOCK} = tile_col) AS n_own, CAST(sum(v) AS BIGINT) AS total
        FROM t JOIN g ON r >= tile_row * {BLOCK} - 2 AND r < tile_row * {BLOCK} + {BLOCK + 2} AND c >= tile_col * {BLOCK} - 2 AND c < tile_col * {BLOCK} + {BLOCK + 2} GROUP BY ALL""",
    "pyramid_all": f"WITH {_G}, {_pyramid(LEVELS)} {_ALL_LEVELS}",
    "sparse_tiles": f"""WITH {_INDEX}, {_placed()}, ext AS (SELECT level, max(tile_row) AS nr, max(tile_col) AS nc FROM idx GROUP BY level),
        cells AS (SELECT level, tile_row, unnest(range(0, nc + 1)) AS tile_col FROM (SELECT level, nc, unnest(range(0, nr + 1)) AS tile_row FROM ext)), planes AS (SELECT * FROM cells, (VALUES (false), (true)) p(is_mask))
        SELECT level, CAST(tile_row AS INTEGER) AS tile_row, CAST(tile_col AS INTEGER) AS tile_col, is_mask, coalesce(off, 0) AS off, coalesce(nbytes, 0) AS nbytes FROM planes LEFT JOIN placed USING (level, tile_row, tile_col, is_mask)""",
    "tile_order": f"WITH {_INDEX} SELECT level, tile_row, tile_col, is_mask, row_number() OVER ({_ORDER}) - 1 AS seq FROM idx",
    "layout_offsets": f"WITH {_INDEX}, {_placed()} SELECT * FROM placed",
    "layout_ghost": f"WITH {_INDEX}, {_placed(extra=8)} SELECT * FROM placed",
    "ifd_align": f"""WITH {_INDEX}, {_placed('(level > 0 OR NOT is_mask)')},
        i AS (SELECT level, count(*) AS image_tiles, CAST(sum(nbytes) AS BIGINT) AS image_bytes, min(off) AS image_first FROM placed WHERE NOT is_mask GROUP BY level),
        m AS (SELECT level, count(*) AS mask_tiles, CAST(sum(nbytes) AS BIGINT) AS mask_bytes, min(off) AS mask_first FROM placed WHERE is_mask GROUP BY level)
        SELECT * FROM i FULL JOIN m USING (level)""",
    "mpu_ntile": f"WITH {_INDEX} SELECT level, tile_row, tile_col, is_mask, CAST(ntile(100) OVER ({_ORDER}) AS INTEGER) AS grp FROM idx WHERE nbytes > 0",
    "mpu_plan": f"""WITH {_INDEX}, {_placed(header=0)}, cut AS (SELECT off, nbytes, unnest(range(off // 5000, (off + nbytes - 1) // 5000 + 1)) AS p FROM placed)
        SELECT CAST(p + 1 AS INTEGER) AS part_no, count(*) AS pieces, CAST(sum(least(off + nbytes, (p + 1) * 5000) - greatest(off, p * 5000)) AS BIGINT) AS nbytes FROM cut GROUP BY p""",
    "cog_roundtrip": _SCAN,
    "cog_pyramid": f"WITH {_G}, {_pyramid(LEVELS)} {_ALL_LEVELS}",
    "cog_window": f"WITH {_G} SELECT band, r, c, v FROM g WHERE r BETWEEN 40 AND 90 AND c BETWEEN 20 AND 40",
    "tile_patch": f"""WITH {_G}, p AS (SELECT band, r, c, CASE WHEN r < 16 AND c >= 16 AND c < 32 THEN v + 1000 ELSE v END AS v FROM g), {_pyramid(1, 'p')} SELECT band, r, c, CAST(v AS BIGINT) AS v FROM l1""",
}

