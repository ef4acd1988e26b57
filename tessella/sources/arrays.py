"""Arrays as rasters: what the driver has, chunked arrays that tasks read, labelled arrays that know their place, and array files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.grid import THIN_CHUNK
from ..functions.options import DEFAULTS, checked, overlaid
from ..operators.tiles import TILES, Raster, batch_of, from_array
from ..plans.cog import with_mask, write_cog
from .multipart import Store
from .reader import PARTITION_BYTES


def georeference_of(arr: Any) -> dict[str, Any]:
    """transform, crs and nodata of an array with a ``rio`` accessor; nothing of others."""
    rio = getattr(arr, "rio", None)
    if rio is None:
        return {}
    found = {"transform": tuple(rio.transform())[:6], "crs": None if rio.crs is None else str(rio.crs), "nodata": rio.nodata}
    return {k: v for k, v in found.items() if v is not None}


def write_array(spark: SparkSession, arr: Any, mask: Any = None, *, store: str | Store | None = None, options: Mapping[str, Any] | None = None, storage_options: Mapping[str, Any] | None = None) -> bytes | str | Store:
    """Writes an array (two axes, or three with bands first), or returns the bytes of the file.

    An array that has chunks (see chunks_of) stays where it is: tasks take its chunks, one at a time, and
    so they take the mask's if it has chunks too.  Of others anything that numpy can make an array of will
    do; it has to fit into the driver.  A mask has the image's height and width, and non-zero is
    valid.  The user's options win over what the array knows of itself.
    """
    own = overlaid(DEFAULTS, georeference_of(arr), checked(options or {}))
    if (chunks := chunks_of(arr)) is not None:
        lazy = mask is not None and chunks_of(mask) is not None
        raster = from_chunks(spark, windows_of(arr), chunks, np.dtype(arr.dtype).name, int(own["blocksize"]), own.get("nodata"), windows_of(mask) if lazy else None)
        raster = raster if mask is None or lazy else with_mask(raster, np.asarray(mask))
    else:
        raster = from_array(spark, np.asarray(arr), None if mask is None else np.asarray(mask), int(own["blocksize"]), own.get("nodata"))
    named = {k: v for k, v in own.items() if k not in DEFAULTS or v != DEFAULTS[k]}
    return write_cog(raster, store, named, storage_options, stage=False)


Window = Callable[[int, int, int, int], np.ndarray]


def chunks_of(arr: Any) -> tuple[tuple[int, ...], ...] | None:
    """The sizes of the chunks along each axis of an array that is made of chunks, else None.

    Arrays tell them as sizes along each axis, or as the one size that all but the last have.
    """
    chunks = getattr(arr, "chunks", None)
    if not chunks or isinstance(arr, np.ndarray):
        return None
    if all(isinstance(c, (int, np.integer)) for c in chunks):
        return tuple(tuple(min(c, n - a) for a in range(0, n, c)) for c, n in zip(map(int, chunks), arr.shape, strict=True))
    return tuple(tuple(map(int, c)) for c in chunks)


def windows_of(arr: Any) -> Window:
    """What fetches a window (rows and columns, from and to) of an array that can be sliced.  It goes to the tasks, so
    the array itself must be something that can be sent: a reference to its data, not the data."""

    def fetch(top: int, bottom: int, left: int, right: int) -> np.ndarray:
        return np.asarray(arr[..., top:bottom, left:right])

    return fetch


def _checked_axis(sizes: tuple[int, ...], blocksize: int, axis: str) -> list[int]:
    """Where the chunks of an axis begin, and its end; a thin last one joins the one before."""
    if any(s % blocksize for s in sizes[:-1]):
        raise ValueError(f"chunks of {axis} must be multiples of {blocksize}, all but the last")
    joined = (*sizes[:-2], sizes[-2] + sizes[-1]) if len(sizes) > 1 and sizes[-1] <= THIN_CHUNK else sizes
    return [0, *np.cumsum(joined).tolist()]


def from_chunks(spark: SparkSession, fetch: Window, chunks: tuple[tuple[int, ...], ...], dtype: str, blocksize: int = 512, nodata: float | None = None, fetch_mask: Window | None = None) -> Raster:
    """A raster of an array whose chunks are fetched by tasks, each once; the driver has their sizes only.

    chunks: their sizes along (bands,) rows and columns.  There is one along the bands; along rows and columns
    all but the last are multiples of the blocksize, so a chunk makes whole tiles and no pixel is exchanged.
    """
    if len(chunks) not in (2, 3):
        raise ValueError("an image has two or three axes")
    if len(chunks) == 3 and len(chunks[0]) != 1:
        raise ValueError("all bands must be in one chunk")
    bands = chunks[0][0] if len(chunks) == 3 else 1
    tops, lefts = (_checked_axis(c, blocksize, axis) for c, axis in zip(chunks[-2:], ("rows", "columns"), strict=True))
    kind, across = np.dtype(dtype).newbyteorder("<"), len(lefts) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                i, j = divmod(number, across)
                top, left = tops[i], lefts[j]
                window = (top, tops[i + 1], left, lefts[j + 1])
                data = fetch(*window)
                data = data[None] if data.ndim == 2 else data
                mask = None if fetch_mask is None else np.asarray(fetch_mask(*window)).reshape(data.shape[1:]) != 0
                for y in range(0, data.shape[1], blocksize):
                    for x in range(0, data.shape[2], blocksize):
                        at = (slice(y, y + blocksize), slice(x, x + blocksize))
                        part = np.ascontiguousarray(data[(slice(None), *at)], kind)
                        over = None if mask is None else mask[at].astype(np.uint8).tobytes()
                        yield batch_of([(0, (top + y) // blocksize, (left + x) // blocksize, part.shape[1], part.shape[2], part.tobytes(), over)], TILES)

    count = across * (len(tops) - 1)
    largest = max(chunks[-2]) * max(chunks[-1]) * bands * kind.itemsize
    tasks = -(-count // max(1, PARTITION_BYTES // max(1, largest)))
    numbers = spark.range(0, count, 1, max(1, tasks))
    return Raster(numbers.mapInArrow(run, TILES), tops[-1], lefts[-1], bands, np.dtype(dtype).name, blocksize, nodata, 0, fetch_mask is not None)


def from_npy(spark: SparkSession, path: str, mask_path: str | None = None, blocksize: int = 512, nodata: float | None = None) -> Raster:
    """A raster of an array file (.npy) on a disk that all tasks share.

    Each task maps the file and copies its tiles out of it: the driver reads the header only, and
    nothing is read twice.
    """
    whole = np.load(path, mmap_mode="r")
    if whole.ndim not in (2, 3):
        raise ValueError("an image has two or three axes")
    bands, (height, width) = (1 if whole.ndim == 2 else whole.shape[0]), whole.shape[-2:]
    dtype = whole.dtype.name
    if mask_path and np.load(mask_path, mmap_mode="r").shape != (height, width):
        raise ValueError("the mask must have the image's height and width")
    rows, cols = -(-height // blocksize), -(-width // blocksize)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.load(path, mmap_mode="r")
        data = data[None] if data.ndim == 2 else data
        mask = np.load(mask_path, mmap_mode="r") if mask_path else None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                row, col = divmod(number, cols)
                at = (slice(row * blocksize, (row + 1) * blocksize), slice(col * blocksize, (col + 1) * blocksize))
                part = np.ascontiguousarray(data[(slice(None), *at)], np.dtype(dtype).newbyteorder("<"))
                over = None if mask is None else (mask[at] != 0).astype(np.uint8).tobytes()
                yield batch_of([(0, row, col, part.shape[1], part.shape[2], part.tobytes(), over)], TILES)

    # Consecutive tiles of a row share pages of the file, so they go to one task.
    tasks = max(1, min(rows * cols, 4 * spark.sparkContext.defaultParallelism))
    numbers = spark.range(0, rows * cols, 1, tasks).select(F.col("id"))
    return Raster(numbers.mapInArrow(run, TILES), height, width, bands, dtype, blocksize, nodata, 0, mask_path is not None)
