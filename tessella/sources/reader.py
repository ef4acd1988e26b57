"""A Spark data source that reads tiles of a tiled TIFF file, of all levels.

The driver reads the directories, not the arrays of tile offsets: a task reads its own piece of them.
Filters on level, tile_row and tile_col choose the partitions, so a window of one level reads only
its tiles.  A partition is a run of tiles over as many rows of tiles as its bytes allow; blocks that lie
near each other in the file come in one request.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.grid import tile_count
from ..operators.tiles import TILES, Raster, _filler, batch_of, holds
from .codecs import decoded, summed
from .tiff import Page, by_level, parse

NAME = "tessella_tiff"
#: Bytes of pixels of one partition.
PARTITION_BYTES = 64 << 20
#: Bytes of pixels of one Arrow batch, of one request, and between blocks that one request brings.
BATCH_BYTES, REQUEST_BYTES, GAP_BYTES = 8 << 20, 8 << 20, 64 << 10


def fetcher(path: str):
    """fetch(offset, length) of a local file or an address that Arrow's file systems know."""
    import pyarrow.fs as pafs

    system, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    file = system.open_input_file(inside)

    def fetch(offset: int, length: int) -> bytes:
        return file.read_at(length, offset)

    return fetch


def pages_of(path: str) -> list[tuple[Page, Page | None]]:
    return by_level(parse(fetcher(path)))


@dataclass
class Run(InputPartition):
    """Tiles [start, stop) of a window of a level, counted row by row.  The window has the tile rows from
    ``row`` on and the tile columns [col, col + cols)."""

    level: int
    page: Page
    mask: Page | None
    row: int
    col: int
    cols: int
    start: int
    stop: int

    def stretches(self) -> Iterator[tuple[int, int, int]]:
        """(tile row, first column, columns) of each row of tiles that the run meets."""
        at = self.start
        while at < self.stop:
            row, col = divmod(at, self.cols)
            n = min(self.stop - at, self.cols - col)
            yield self.row + row, self.col + col, n
            at += n


@dataclass
class Bounds:
    """The least and most of a column, and the only values if they are listed."""

    least: int = 0
    most: int = 1 << 62
    among: frozenset[int] | None = None

    def has(self, n: int) -> bool:
        return self.least <= n <= self.most and (self.among is None or n in self.among)

    def ranges(self, count: int) -> list[tuple[int, int]]:
        """(first, how many) of each run of numbers below count that are within."""
        first, last = max(0, self.least), min(count - 1, self.most)
        if self.among is None:
            return [(first, last + 1 - first)] if first <= last else []
        out: list[tuple[int, int]] = []
        for n in sorted(x for x in self.among if first <= x <= last):
            if out and sum(out[-1]) == n:
                out[-1] = (out[-1][0], out[-1][1] + 1)
            else:
                out.append((n, 1))
        return out


class TiffReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int) -> None:
        self.path, self.partition_bytes = path, partition_bytes
        self.bounds = {name: Bounds() for name in ("level", "tile_row", "tile_col")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            b = self.bounds.get(name)
            if b is not None and isinstance(f, EqualTo):
                b.least, b.most = max(b.least, f.value), min(b.most, f.value)
            elif b is not None and isinstance(f, In):
                b.among = frozenset(f.value) if b.among is None else b.among & frozenset(f.value)
            elif b is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                b.least = max(b.least, f.value + isinstance(f, GreaterThan))
            elif b is not None and isinstance(f, (LessThan, LessThanOrEqual)):
                b.most = min(b.most, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Run]:
        out = []
        for level, (page, mask) in enumerate(pages_of(self.path)):
            if not self.bounds["level"].has(level):
                continue
            b = page.blocksize
            size = b * b * page.bands * np.dtype(page.dtype).itemsize
            step = max(1, self.partition_bytes // size)
            for col, cols in self.bounds["tile_col"].ranges(tile_count(page.width, b)):
                for row, rows in self.bounds["tile_row"].ranges(tile_count(page.height, b)):
                    out += [Run(level, page, mask, row, col, cols, a, min(a + step, rows * cols)) for a in range(0, rows * cols, step)]
        # An empty list would read as one partition without a value.
        return out or [Run(0, None, None, 0, 0, 1, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        fetch = fetcher(self.path)
        page, mask = partition.page, partition.mask
        b, dtype = page.blocksize, np.dtype(page.dtype).newbyteorder("<")
        across = tile_count(page.width, b)
        nodata = page.nodata if page.nodata is not None and holds(page.dtype, page.nodata) else None
        fill = _filler(nodata, page.dtype)
        tiles = np.array([(row, col + k) for row, col, n in partition.stretches() for k in range(n)], np.int64)
        numbers = tiles[:, 0] * across + tiles[:, 1]

        def array(place: tuple[int, int, int]) -> np.ndarray:
            """The entries of these tiles: whole rows of a narrow window are read together with what lies between."""
            at, width, _ = place
            first, last = int(numbers[0]), int(numbers[-1])
            if last - first < 4 * len(numbers) + 4096:
                return np.frombuffer(fetch(at + first * width, (last - first + 1) * width), f"<u{width}").astype(np.int64)[numbers - first]
            rows = [fetch(at + (row * across + col) * width, n * width) for row, col, n in partition.stretches()]
            return np.frombuffer(b"".join(rows), f"<u{width}").astype(np.int64)

        none = np.zeros(len(tiles), np.int64)
        at, size = array(page.offsets), array(page.counts)
        mask_at, mask_size = (none, none) if mask is None else (array(mask.offsets), array(mask.counts))
        rows, held = [], 0
        # The blocks of the image and of the mask lie mixed in the file, so they are fetched in one order.
        wanted = ranges(np.concatenate([at, mask_at]), np.concatenate([size, mask_size]), fetch)
        found: dict[int, bytes] = {}
        for k, (row, col) in enumerate(tiles.tolist()):
            if not size[k] and not mask_size[k] and (mask is not None or nodata is not None):
                continue
            for j, there in ((k, size[k]), (len(tiles) + k, mask_size[k])):
                while there and j not in found:
                    found.update(next(wanted))
            h, w = min(b, page.height - row * b), min(b, page.width - col * b)
            if size[k]:
                raw = decoded(found.pop(k), page.codec, b * b * page.bands * dtype.itemsize)
                block = summed(raw, page.predictor, (b, b, page.bands), dtype)
                data = np.ascontiguousarray(block[:h, :w].transpose(2, 0, 1)).tobytes()
            else:
                data = np.full((page.bands, h, w), fill, dtype).tobytes()
            over = None
            if mask is not None:
                bits = np.unpackbits(np.frombuffer(decoded(found.pop(len(tiles) + k), mask.codec, b * b // 8), np.uint8)).reshape(b, b) if mask_size[k] else np.zeros((b, b), np.uint8)
                over = np.ascontiguousarray(bits[:h, :w]).tobytes()
            rows.append((partition.level, row, col, h, w, data, over))
            held += len(data)
            if held > BATCH_BYTES:
                yield batch_of(rows, TILES)
                rows, held = [], 0
        if rows:
            yield batch_of(rows, TILES)


def ranges(at: np.ndarray, size: np.ndarray, fetch) -> Iterator[dict[int, bytes]]:
    """The byte ranges by their numbers, in the order of the file; near ones come from one request."""
    order = np.argsort(at, kind="stable")
    order = order[size[order] > 0]
    first = 0
    while first < len(order):
        start, last = int(at[order[first]]), first
        stop = start + int(size[order[first]])
        while last + 1 < len(order):
            k = order[last + 1]
            if at[k] - stop > GAP_BYTES or at[k] + size[k] - start > REQUEST_BYTES:
                break
            last, stop = last + 1, max(stop, int(at[k] + size[k]))
        data = fetch(start, stop - start)
        yield {int(k): data[int(at[k]) - start : int(at[k] + size[k]) - start] for k in order[first : last + 1]}
        first = last + 1


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_tiles(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The tiles of all levels.  Filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    return spark.read.format(NAME).option("path", path).option("partition_bytes", partition_bytes).load()


def read_cog(spark: SparkSession, path: str, level: int = 0, bbox: tuple[int, int, int, int] | None = None) -> Raster:
    """A level of a file as a raster.  bbox: (first row, first column, last row, last column) in pixels of
    the level; tiles that meet it are read."""
    levels = pages_of(path)
    page, mask = levels[level]
    tiles = read_tiles(spark, path).where(F.col("level") == level)
    if bbox:
        r0, c0, r1, c1 = (x // page.blocksize for x in bbox)
        tiles = tiles.where((F.col("tile_row") >= r0) & (F.col("tile_row") <= r1) & (F.col("tile_col") >= c0) & (F.col("tile_col") <= c1))
    # A file may name a value that its pixels can't have; then no pixel is nodata.
    nodata = page.nodata if page.nodata is not None and holds(page.dtype, page.nodata) else None
    return Raster(tiles, page.height, page.width, page.bands, page.dtype, page.blocksize, nodata, level, mask is not None)
