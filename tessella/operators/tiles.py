"""Rasters as rows of tiles, the form for dense and large rasters.

A row is one tile of one level: level, tile_row, tile_col, height, width (of the part inside the image),
payload (bands x height x width values, little-endian, band by band) and mask (height x width bytes,
non-zero: valid; null: all are).  A tile without a valid pixel may be absent.  Rows are independent, so
a raster of any size is a stream of Arrow batches; only overviews move data, and of the kernels without
a halo they move a quarter of it, already resampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import halved, tile_count
from ..functions.kernels import HALO, TAPS
from ..session import bounded_batches, written

TILES = "level int, tile_row int, tile_col int, height int, width int, payload binary, mask binary"
#: A piece of a level on its way to a tile of the next: where it goes, where it lies (from the image's corner).
PIECES = "tile_row int, tile_col int, y int, x int, height int, width int, payload binary, mask binary"
DTYPES = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float32", "float64")


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[] for _ in schema], schema, strict=True)], schema=schema)


def holds(dtype: str, value: float) -> bool:
    """Whether a pixel of the type can have the value."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return True
    return value == value and float(value).is_integer() and np.iinfo(kind).min <= value <= np.iinfo(kind).max


@dataclass(frozen=True)
class Raster:
    """Tiles of one level of an image, and what its tiles have in common."""

    tiles: DataFrame
    height: int
    width: int
    bands: int
    dtype: str
    blocksize: int = 512
    nodata: float | None = None
    level: int = 0
    has_mask: bool = False

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"pixels of type {self.dtype} are not supported")
        if self.blocksize < 16 or self.blocksize % 16:
            raise ValueError("blocksize must be a multiple of 16")
        if min(self.height, self.width, self.bands) < 1:
            raise ValueError("an image has at least one pixel and one band")
        if self.nodata is not None and not holds(self.dtype, self.nodata):
            raise ValueError(f"no pixel of type {self.dtype} can be {self.nodata}: give another nodata value, or none and a mask")

    @property
    def tile_rows(self) -> int:
        return tile_count(self.height, self.blocksize)

    @property
    def tile_cols(self) -> int:
        return tile_count(self.width, self.blocksize)


# One tile: numpy.


def unpacked(payload: bytes, bands: int, height: int, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(payload, np.dtype(dtype).newbyteorder("<")).reshape(bands, height, width)


def valid_pixels(data: np.ndarray, mask: np.ndarray | None, nodata: float | None) -> np.ndarray:
    """bands x height x width: in the mask and not nodata.  NaN as nodata means NaN pixels."""
    if nodata is None:
        valid = np.ones(data.shape, bool)
    elif nodata != nodata:
        valid = ~np.isnan(data) if data.dtype.kind == "f" else np.ones(data.shape, bool)
    else:
        valid = data != nodata
    return valid if mask is None else valid & (mask != 0)


def fitted(values: np.ndarray, dtype: str) -> np.ndarray:
    """Values in the type of the pixels; whole types round half away from zero and stop at their ends."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return values.astype(kind)
    ends = np.iinfo(kind)
    # trunc(x + 0.5) errs for the double just below 0.5; the difference from the floor doesn't.
    size = np.abs(values)
    low = np.floor(size)
    whole = np.copysign(low + (size - low >= 0.5), values)
    # The ends of 64-bit types aren't doubles; what reaches them is put there by comparison.
    out = np.zeros(values.shape, kind)
    inside = (whole > ends.min) & (whole < ends.max)
    out[inside] = whole[inside].astype(kind)
    out[whole >= ends.max] = ends.max
    out[whole <= ends.min] = ends.min
    return out


def _quarters(data: np.ndarray) -> np.ndarray:
    """bands x height x width x 4: the 2 x 2 source pixels of each output pixel."""
    return np.stack([data[..., 0::2, 0::2], data[..., 0::2, 1::2], data[..., 1::2, 0::2], data[..., 1::2, 1::2]], -1)


def reduced(data: np.ndarray, valid: np.ndarray, kernel: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and validity of half the size, for kernels without a halo.  Both sides are even."""
    if kernel == "nearest":
        return data[..., 0::2, 0::2].copy(), valid[..., 0::2, 0::2].copy()
    cells, ok = _quarters(data), _quarters(valid)
    n = ok.sum(-1)
    any_ = n > 0
    if kernel == "mode":
        # How often each of the four occurs; among the most frequent the smallest.
        same = ((cells[..., :, None] == cells[..., None, :]) & ok[..., None, :]).sum(-1) * ok
        most = same == same.max(-1, keepdims=True)
        high = np.inf if cells.dtype.kind == "f" else np.iinfo(cells.dtype).max
        return np.where(most & ok, cells, np.array(high, cells.dtype)).min(-1), any_
    kind = np.float64 if cells.dtype.kind == "f" or cells.dtype.itemsize > 4 else np.int64
    x = np.where(ok, cells, 0).astype(kind)
    if kernel == "average":
        out = x.sum(-1) / np.maximum(n, 1)
    else:
        out = np.sqrt((x.astype(np.float64) ** 2).sum(-1) / np.maximum(n, 1))
    return fitted(out, dtype), any_


def tapped(data: np.ndarray, valid: np.ndarray, kernel: str, dtype: str, halo: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for tap kernels: data and valid have halo pixels around what becomes height x width."""
    first, weights = TAPS[kernel]
    # Whole numbers of up to 16 bits keep exact sums in 64 bits with any kernel here.
    exact = data.dtype.kind in "iu" and data.dtype.itemsize <= 2
    kind = np.int64 if exact else np.float64
    value = np.where(valid, data, 0).astype(kind)

    def along(x: np.ndarray, axis: int, n: int) -> np.ndarray:
        out = part = None
        for i, w in enumerate(weights):
            at = [slice(None)] * x.ndim
            at[axis] = slice(halo + first + i, halo + first + i + 2 * n, 2)
            if out is None:
                out = w * x[tuple(at)]
                part = np.empty_like(out)
            else:
                out += np.multiply(x[tuple(at)], w, out=part)
        return out

    num = along(along(value, -1, width), -2, height)
    rows, cols = valid.any((0, 2)), valid.any((0, 1))
    if valid.sum() == len(valid) * rows.sum() * cols.sum():
        # No holes: the weights of rows and columns tell those of all pixels.
        den = np.multiply.outer(along(rows.astype(np.int64), 0, height), along(cols.astype(np.int64), 0, width))[None]
    else:
        den = along(along(valid.astype(np.int64), -1, width), -2, height)
    own = _quarters(valid[..., halo : halo + 2 * height, halo : halo + 2 * width]).any(-1) & (den != 0)
    return fitted(num / np.where(den == 0, 1, den), dtype), own


def _filler(nodata: float | None, dtype: str) -> float | int:
    """What an invalid pixel holds."""
    if nodata is None:
        return 0
    if not holds(dtype, nodata):
        raise ValueError(f"no pixel of type {dtype} can be {nodata}")
    return nodata if np.dtype(dtype).kind == "f" else int(nodata)


# Tables of tiles.


def from_array(spark: SparkSession, data: np.ndarray, mask: np.ndarray | None = None, blocksize: int = 512, nodata: float | None = None, slices: int | None = None) -> Raster:
    """A raster of an array that the driver has (two axes: one band)."""
    data = np.asarray(data)
    if data.ndim == 2:
        data = data[None]
    if data.ndim != 3:
        raise ValueError("an image has two or three axes")
    if mask is not None and np.shape(mask) != data.shape[1:]:
        raise ValueError("the mask must have the image's height and width")
    bands, height, width = data.shape
    kind = np.dtype(data.dtype.name).newbyteorder("<")
    rows = []
    for y in range(0, height, blocksize):
        for x in range(0, width, blocksize):
            part = np.ascontiguousarray(data[:, y : y + blocksize, x : x + blocksize], kind)
            some = None if mask is None else (np.asarray(mask)[y : y + blocksize, x : x + blocksize] != 0).astype(np.uint8).tobytes()
            rows.append((0, y // blocksize, x // blocksize, part.shape[1], part.shape[2], part.tobytes(), some))
    tiles = spark.createDataFrame(pa.Table.from_batches([batch_of(rows, TILES)]), TILES)
    return Raster(tiles.repartition(slices) if slices else tiles, height, width, bands, data.dtype.name, blocksize, nodata, 0, mask is not None)


def from_pixels(pixels: DataFrame, height: int, width: int, bands: int, dtype: str, blocksize: int = 512, nodata: float | None = None) -> Raster:
    """A raster of rows of pixels (band, r, c, v; valid if there is a mask, alike in all bands).  Pixels that
    have no row are invalid: nodata, or else outside the mask."""
    masks = "valid" in pixels.columns
    b = blocksize
    tile = lambda c: F.call_function("div", F.col(c), F.lit(b)).cast("int")
    placed = pixels.select(tile("r").alias("tile_row"), tile("c").alias("tile_col"), F.col("band").cast("int").alias("band"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v", *(["valid"] if masks else []))
    fill = _filler(nodata, dtype)
    with_mask = masks or nodata is None

    def assemble(key: tuple, group: pa.Table) -> pa.Table:
        row, col = (k.as_py() for k in key)
        h, w = min(b, height - row * b), min(b, width - col * b)
        data, mask = np.full((bands, h, w), fill, np.dtype(dtype).newbyteorder("<")), np.zeros((h, w), np.uint8)
        at = {name: group.column(name).to_numpy(zero_copy_only=False) for name in ("band", "r", "c", "v")}
        y, x = at["r"] - row * b, at["c"] - col * b
        data[at["band"] - 1, y, x] = at["v"]
        mask[y, x] = group.column("valid").to_numpy(zero_copy_only=False) if masks else 1
        return pa.Table.from_batches([batch_of([(0, row, col, h, w, data.tobytes(), mask.tobytes() if with_mask else None)], TILES)])

    inside = placed.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1) & F.col("band").between(1, bands) & F.col("v").isNotNull())
    tiles = inside.groupBy("tile_row", "tile_col").applyInArrow(assemble, TILES)
    return Raster(tiles, height, width, bands, dtype, blocksize, nodata, 0, with_mask)


def to_pixels(raster: Raster, only_valid: bool = True) -> DataFrame:
    """band, r, c, v (double for floats, else bigint) and valid of every pixel that a tile holds."""
    kind = "double" if np.dtype(raster.dtype).kind == "f" else "long"
    schema = f"band int, r int, c int, v {kind}, valid boolean"
    bounded_batches(raster.tiles.sparkSession)
    b, bands, dtype, nodata = raster.blocksize, raster.bands, raster.dtype, raster.nodata

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                data = unpacked(row["payload"], bands, h, w, dtype)
                valid = valid_pixels(data, None if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(h, w), nodata)
                k, y, x = np.nonzero(valid) if only_valid else (i.ravel() for i in np.indices(data.shape))
                yield pa.RecordBatch.from_arrays([pa.array((k + 1).astype(np.int32)), pa.array((y + row["tile_row"] * b).astype(np.int32)), pa.array((x + row["tile_col"] * b).astype(np.int32)), pa.array(data[k, y, x].astype(np.float64 if kind == "double" else np.int64)), pa.array(valid[k, y, x])], schema=fields)

    return raster.tiles.mapInArrow(run, schema)


def _pieces(raster: Raster, kernel: str) -> DataFrame:
    """What the tiles of the next level need of each tile: for kernels without a halo its own half-size
    part, else the tile and the strips that reach over the border of the four tiles that become one."""
    b, bands, dtype, nodata = raster.blocksize, raster.bands, raster.dtype, raster.nodata
    high, wide = halved(raster.height), halved(raster.width)
    rows, cols = tile_count(high, b), tile_count(wide, b)
    halo = HALO[kernel]
    fill = _filler(nodata, dtype)
    bounded_batches(raster.tiles.sparkSession)

    def halves(row: dict) -> Iterator[tuple]:
        h, w = row["height"], row["width"]
        data = unpacked(row["payload"], bands, h, w, dtype)
        mask = None if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(h, w)
        y, x = row["tile_row"] * b // 2, row["tile_col"] * b // 2
        oh, ow = min(max(1, h // 2), high - y), min(max(1, w // 2), wide - x)
        if oh < 1 or ow < 1:
            return  # an odd last row or column alone
        # An axis of one pixel is its own overview; its missing neighbour is invalid.
        pad = ((0, 0), (0, max(0, 2 * oh - h)), (0, max(0, 2 * ow - w)))
        valid = np.pad(valid_pixels(data, mask, nodata), pad)[:, : 2 * oh, : 2 * ow]
        values, ok = reduced(np.pad(data, pad)[:, : 2 * oh, : 2 * ow], valid, kernel, dtype)
        yield _piece(y // b, x // b, y, x, values, ok, mask, kernel)

    def _piece(tile_row: int, tile_col: int, y: int, x: int, values: np.ndarray, ok: np.ndarray, mask: np.ndarray | None, kernel: str) -> tuple:
        out = np.where(ok, values, np.array(fill, values.dtype)).astype(np.dtype(dtype).newbyteorder("<"))
        over = None
        if mask is not None:
            m = np.zeros((2 * values.shape[1], 2 * values.shape[2]), bool)
            part = mask[: m.shape[0], : m.shape[1]] != 0
            m[: part.shape[0], : part.shape[1]] = part
            over = (m[0::2, 0::2] if kernel == "nearest" else _quarters(m).any(-1)).astype(np.uint8).tobytes()
        return tile_row, tile_col, y, x, values.shape[1], values.shape[2], out.tobytes(), over

    def strips(row: dict) -> Iterator[tuple]:
        h, w = row["height"], row["width"]
        y, x = row["tile_row"] * b, row["tile_col"] * b
        data = unpacked(row["payload"], bands, h, w, dtype)
        mask = None if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(h, w)
        for pr in range(max(0, (y - halo) // (2 * b)), min(rows - 1, (y + h - 1 + halo) // (2 * b)) + 1):
            for pc in range(max(0, (x - halo) // (2 * b)), min(cols - 1, (x + w - 1 + halo) // (2 * b)) + 1):
                y0, y1 = max(y, 2 * b * pr - halo), min(y + h, 2 * b * (pr + 1) + halo)
                x0, x1 = max(x, 2 * b * pc - halo), min(x + w, 2 * b * (pc + 1) + halo)
                if y0 < y1 and x0 < x1:
                    cut = np.ascontiguousarray(data[:, y0 - y : y1 - y, x0 - x : x1 - x])
                    yield pr, pc, y0, x0, y1 - y0, x1 - x0, cut.tobytes(), None if mask is None else np.ascontiguousarray(mask[y0 - y : y1 - y, x0 - x : x1 - x]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if out := list(strips(row) if halo else halves(row)):
                    yield batch_of(out, PIECES)

    return raster.tiles.mapInArrow(run, PIECES)


def overview(raster: Raster, kernel: str) -> Raster:
    """The next level of half the size.  One exchange, by the tile that pieces meet in."""
    b, bands, dtype, nodata, level, has_mask = raster.blocksize, raster.bands, raster.dtype, raster.nodata, raster.level + 1, raster.has_mask
    high, wide = halved(raster.height), halved(raster.width)
    halo, fill = HALO[kernel], _filler(nodata, dtype)
    kind = np.dtype(dtype).newbyteorder("<")

    def assemble(key: tuple, group: pa.Table) -> pa.Table:
        row, col = (k.as_py() for k in key)
        h, w = min(b, high - row * b), min(b, wide - col * b)
        # The window that the pieces fill: the tile itself, or its source with the halo.
        y0, x0 = (2 * b * row - halo, 2 * b * col - halo) if halo else (row * b, col * b)
        wh, ww = (2 * h + 2 * halo, 2 * w + 2 * halo) if halo else (h, w)
        data, there, mask = np.full((bands, wh, ww), fill, kind), np.zeros((wh, ww), bool), np.zeros((wh, ww), np.uint8)
        for piece in group.to_pylist():
            ph, pw = piece["height"], piece["width"]
            a, c = piece["y"] - y0, piece["x"] - x0
            part = unpacked(piece["payload"], bands, ph, pw, dtype)
            part_mask = np.ones((ph, pw), np.uint8) if piece["mask"] is None else np.frombuffer(piece["mask"], np.uint8).reshape(ph, pw)
            # A piece may reach beyond the window where the next level drops an odd end; taps don't go there.
            src = (slice(max(0, -a), min(ph, wh - a)), slice(max(0, -c), min(pw, ww - c)))
            dst = (slice(max(0, a), min(wh, a + ph)), slice(max(0, c), min(ww, c + pw)))
            data[(slice(None), *dst)] = part[(slice(None), *src)]
            there[dst] = True
            mask[dst] = part_mask[src]
        if halo:
            valid = valid_pixels(data, mask, nodata) & there
            values, own = zip(*(tapped(data[k : k + 1], valid[k : k + 1], kernel, dtype, halo, h, w) for k in range(bands)), strict=True)
            data = np.where(np.concatenate(own), np.concatenate(values), np.array(fill, kind)).astype(kind)
            mask = _quarters(mask[halo : halo + 2 * h, halo : halo + 2 * w] != 0).any(-1).astype(np.uint8)
        out = (level, row, col, h, w, data.tobytes(), mask.tobytes() if has_mask else None)
        return pa.Table.from_batches([batch_of([out], TILES)])

    tiles = _pieces(raster, kernel).groupBy("tile_row", "tile_col").applyInArrow(assemble, TILES)
    return replace(raster, tiles=tiles, height=high, width=wide, level=level)


MOMENTS = "band int, max double, mean double, min double, std double, n long"


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and deviation of exact sums."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            n, total, square = row["n"], int(row["total"]), int(row["square"])
            rows.append((row["band"], row["max"], float(total) / n, row["min"], math.sqrt(n * square - total * total) / n, n))
        yield batch_of(rows, MOMENTS)


def band_stats(raster: Raster) -> DataFrame:
    """band, max, mean, min, std and valid_percent over valid pixels.

    Each tile gives one row a band.  Whole-numbered pixels are summed exactly (as decimals across
    tiles); of others each tile gives its mean and its spread about it, which add up as in Chan et al.
    Absent tiles count as invalid pixels.
    """
    bands, dtype, nodata, pixels = raster.bands, raster.dtype, raster.nodata, raster.height * raster.width
    whole = np.dtype(dtype).kind in "iu" and np.dtype(dtype).itemsize <= 4
    bounded_batches(raster.tiles.sparkSession)
    schema = "band int, n long, most double, least double, total string, square string" if whole else "band int, n long, most double, least double, mean double, spread double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                data = unpacked(row["payload"], bands, h, w, dtype)
                valid = valid_pixels(data, None if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(h, w), nodata)
                for k in range(bands):
                    x = data[k][valid[k]]
                    if not len(x):
                        continue
                    if whole:
                        y = x.astype(np.int64)
                        # 32 bits squared fit 64 without a sign, a sum of them does not: halves.
                        z = np.abs(y).astype(np.uint64)
                        z *= z
                        square = int(np.sum(z >> np.uint64(32))) * (1 << 32) + int(np.sum(z & np.uint64(0xFFFFFFFF)))
                        ends = (str(int(y.sum())), str(square))
                    else:
                        z = x.astype(np.float64)
                        ends = (float(z.mean()), float(((z - z.mean()) ** 2).sum()))
                    rows.append((k + 1, len(x), float(x.max()), float(x.min()), *ends))
            yield batch_of(rows, schema)

    parts = raster.tiles.mapInArrow(run, schema)
    every = raster.tiles.sparkSession.range(1, bands + 1).select(F.col("id").cast("int").alias("band"))
    n = F.sum("n")
    if whole:
        # Sums fit 38 digits for 10**18 pixels of 32 bits; their products need not, so the last step, a row a band, has Python's integers.
        total, square = (F.sum(F.col(c).cast("decimal(28,0)")).cast("string").alias(c) for c in ("total", "square"))
        sums = parts.groupBy("band").agg(F.max("most").alias("max"), F.min("least").alias("min"), n.alias("n"), total, square)
        by = sums.mapInArrow(_moments, MOMENTS)
    else:
        centre = parts.groupBy("band").agg((F.sum(F.col("n") * F.col("mean")) / n).alias("centre"))
        parts = written(parts, "partials")  # used twice, and a row a tile and band
        # A row a band.
        off = parts.join(F.broadcast(centre), "band").withColumn("off", F.col("spread") + F.col("n") * (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre")))
        by = off.groupBy("band").agg(F.max("most").alias("max"), F.first("centre").alias("mean"), F.min("least").alias("min"), F.sqrt(F.sum("off") / n).alias("std"), n.alias("n"))
    percent = F.lit(100.0) * (F.lit(1.0) - (F.lit(pixels) - F.coalesce("n", F.lit(0).cast("long"))) / F.lit(float(pixels)))
    return every.join(F.broadcast(by), "band", "left").select("band", "max", "mean", "min", "std", percent.alias("valid_percent"))
