"""Overviews: tiles against pixels against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.grid import halved
from tessella.functions.kernels import HALO, TAPS, taps
from tessella.operators import pixels, resample, tiles


def brute(data, valid, kernel):
    """One band by the definition, with loops."""
    height, width = data.shape
    high, wide = max(1, height // 2), max(1, width // 2)
    out = {}
    for i in range(high):
        for j in range(wide):
            own = [(y, x) for y in (2 * i, 2 * i + 1) for x in (2 * j, 2 * j + 1) if y < height and x < width and valid[y, x]]
            values = [float(data[p]) for p in own]
            if kernel == "nearest":
                if valid[2 * i, 2 * j]:
                    out[i, j] = float(data[2 * i, 2 * j])
                continue
            if not own:
                continue
            if kernel == "average":
                out[i, j] = sum(values) / len(values)
            elif kernel == "rms":
                out[i, j] = (sum(v * v for v in values) / len(values)) ** 0.5
            elif kernel == "mode":
                out[i, j] = min(values, key=lambda v: (-values.count(v), v))
            else:
                num = den = 0
                for ky, wy in taps(kernel):
                    for kx, wx in taps(kernel):
                        y, x = 2 * i + ky, 2 * j + kx
                        if 0 <= y < height and 0 <= x < width and valid[y, x]:
                            num += wy * wx * float(data[y, x])
                            den += wy * wx
                if den:
                    out[i, j] = num / den
    return out


def rows(df):
    return {(r.r, r.c): r.v for r in df.collect()}


def pixel_rows(spark, data, valid):
    at = [(1, int(y), int(x), int(data[y, x])) for y, x in zip(*np.nonzero(valid), strict=True)]
    return spark.createDataFrame(at, "band int, r int, c int, v int")


@pytest.mark.parametrize("kernel", list(HALO))
@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (35, 33), (48, 17)])
def test_forms_agree_with_the_definition(spark, kernel, shape):
    rng = np.random.default_rng(sum(map(ord, kernel)) + shape[0])
    data = rng.integers(-500, 500, shape).astype(np.int16)
    mask = rng.random(shape) < 0.7
    wanted = brute(data, mask, kernel)
    by_pixels = rows(resample.overview(pixel_rows(spark, data, mask), kernel, *shape))
    assert by_pixels.keys() == wanted.keys()
    assert all(abs(by_pixels[k] - wanted[k]) < 1e-9 for k in wanted)
    raster = tiles.overview(tiles.from_array(spark, data, mask, 16), kernel)
    assert (raster.height, raster.width, raster.level) == (halved(shape[0]), halved(shape[1]), 1)
    by_tiles = rows(tiles.to_pixels(raster))
    assert by_tiles.keys() == wanted.keys()
    assert all(by_tiles[k] == int(np.copysign(np.floor(abs(wanted[k]) + 0.5), wanted[k])) for k in wanted)


@pytest.mark.parametrize("kernel", list(HALO))
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64", "uint64"])
def test_constant_stays_constant(spark, kernel, dtype):
    data = np.full((2, 40, 37), 7, dtype)
    raster = tiles.from_array(spark, data, blocksize=16)
    for _ in range(2):
        raster = tiles.overview(raster, kernel)
        found = tiles.to_pixels(raster).agg(F.min("v"), F.max("v"), F.count("v")).first()
        assert tuple(found) == (7, 7, 2 * raster.height * raster.width)


def test_nodata_and_nan(spark):
    data = np.array([[1, -9, 3, 4], [5, 6, -9, -9], [-9, -9, 2, 2], [-9, -9, 2, 4]], np.float32)
    raster = tiles.overview(tiles.from_array(spark, data, blocksize=16, nodata=-9.0), "average")
    assert rows(tiles.to_pixels(raster)) == {(0, 0): 4.0, (0, 1): 3.5, (1, 1): 2.5}
    data[data == -9] = np.nan
    raster = tiles.overview(tiles.from_array(spark, data, blocksize=16, nodata=float("nan")), "average")
    assert rows(tiles.to_pixels(raster)) == {(0, 0): 4.0, (0, 1): 3.5, (1, 1): 2.5}


def test_values_stop_at_the_ends_of_the_type(spark):
    edge = np.zeros((32, 32), np.uint8)
    edge[:, 16:] = 255
    for kernel in ("cubic", "lanczos"):  # they overshoot
        found = tiles.to_pixels(tiles.overview(tiles.from_array(spark, edge, blocksize=16), kernel)).agg(F.min("v"), F.max("v")).first()
        assert tuple(found) == (0, 255)


def test_rounding_is_away_from_zero():
    x = np.array([0.5, 1.5, 2.5, -0.5, -1.5, 0.49999999999999994, 3.2])
    assert tiles.fitted(x, "int16").tolist() == [1, 2, 3, -1, -2, 0, 3]
    assert tiles.fitted(np.array([1e30, -1e30]), "int64").tolist() == [2**63 - 1, -(2**63)]


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_partitions_do_not_matter(spark, slices):
    data = np.random.default_rng(5).integers(0, 100, (70, 50)).astype(np.uint8)
    raster = tiles.from_array(spark, data, blocksize=16, slices=slices)
    for kernel in ("mode", "cubic"):
        one = rows(tiles.to_pixels(tiles.overview(raster, kernel)))
        again = rows(tiles.to_pixels(tiles.overview(tiles.from_array(spark, data, blocksize=16, slices=3), kernel)))
        assert one == again


def test_pyramid_rounds_each_level(spark):
    data = np.random.default_rng(6).integers(-50, 50, (64, 64))
    cells = pixel_rows(spark, data, np.ones((64, 64), bool))
    found = {(r.level, r.r, r.c): r.v for r in resample.pyramid(cells, "average", 64, 64, 3).collect()}
    now = data.astype(float)
    for level in range(1, 4):
        now = now.reshape(now.shape[0] // 2, 2, -1, 2).mean((1, 3))
        now = np.copysign(np.floor(np.abs(now) + 0.5), now)
        assert all(found[level, i, j] == now[i, j] for i, j in np.ndindex(now.shape))


def test_pyramid_reads_each_level_once(spark):
    cells = pixel_rows(spark, np.ones((8, 8), int), np.ones((8, 8), bool))
    plan = resample.pyramid(cells, "average", 8, 8, 2)._jdf.queryExecution().executedPlan().toString()
    # The result is a union of what is written: no exchange is left in it.
    assert "Exchange" not in plan and plan.count("overview1") == 1 and plan.count("overview2") == 1


def test_stats_of_tiles_and_pixels(spark):
    rng = np.random.default_rng(8)
    for dtype in ("int16", "float64"):
        data = (rng.random((2, 50, 40)) * 1000).astype(dtype)
        mask = rng.random((50, 40)) < 0.6
        data[1, :5] = 3
        found = {r.band: r for r in tiles.band_stats(tiles.from_array(spark, data, mask, 16, nodata=3)).collect()}
        for band in (1, 2):
            ok = mask & (data[band - 1] != 3)
            x = data[band - 1][ok].astype(float)
            r = found[band]
            assert (r.max, r.min) == (x.max(), x.min())
            assert r.mean == pytest.approx(x.mean(), rel=1e-12)
            assert r.std == pytest.approx(x.std(), rel=1e-12)
            assert r.valid_percent == pytest.approx(100 * ok.mean())


def test_stats_near_the_end_of_32_bits(spark):
    data = np.full((40, 40), 4294967290, np.uint32)
    data[::2] = 4294967295
    row = tiles.band_stats(tiles.from_array(spark, data, blocksize=16)).first()
    assert (row.max, row.min, row.mean, row.std) == (4294967295.0, 4294967290.0, 4294967292.5, 2.5)
    low = np.full((40, 40), -2147483648, np.int32)
    low[::2] = -2147483644
    assert tiles.band_stats(tiles.from_array(spark, low, blocksize=16)).first().std == 2.0


def test_stats_of_ten_to_the_ten_pixels(spark):
    """Sums whose products are over 38 digits: as a raster of 10**10 pixels would give them."""
    rows = [(1, 4294967295.0, 4294967290.0, 10**10, str(5 * 10**9 * (4294967295 + 4294967290)), str(5 * 10**9 * (4294967295**2 + 4294967290**2)))]
    sums = spark.createDataFrame(rows, "band int, max double, min double, n long, total string, square string")
    row = sums.mapInArrow(tiles._moments, tiles.MOMENTS).first()
    assert (row.mean, row.std) == (4294967292.5, 2.5)


def test_pixel_stats_beyond_38_digits(spark):
    cells = spark.range(2000).selectExpr("1 AS band", "cast(id AS int) AS r", "0 AS c", "9000000000000000000 + id * 100000000000000 AS v")
    row = pixels.band_stats(pixels.masked(cells)).first()
    assert row.std == pytest.approx(np.std(np.arange(2000) * 1e14), rel=1e-9)
    assert row.mean == pytest.approx(9e18 + 999.5e14)


@pytest.mark.parametrize(("dtype", "nodata"), [("uint8", -9999), ("int16", 1.5), ("uint16", float("nan")), ("int8", 128)])
def test_nodata_that_no_pixel_can_be(spark, dtype, nodata):
    with pytest.raises(ValueError, match="nodata"):
        tiles.from_array(spark, np.zeros((4, 4), dtype), blocksize=16, nodata=nodata)
    cells = spark.createDataFrame([(1, 0, 0, 5)], "band int, r int, c int, v int")
    with pytest.raises(ValueError):
        tiles.from_pixels(cells, 16, 16, 1, dtype, 16, nodata)


def test_stats_without_a_valid_pixel(spark):
    raster = tiles.from_array(spark, np.zeros((20, 20), np.uint8), np.zeros((20, 20)), 16)
    row = tiles.band_stats(raster).first()
    assert (row.max, row.mean, row.valid_percent) == (None, None, 0.0)
    cells = pixels.masked(spark.createDataFrame([(1, 0, 0, 5)], "band int, r int, c int, v int"), nodata=5)
    tags = pixels.stats_tags(pixels.band_stats(cells)).collect()
    assert [(t.name, t.value) for t in tags] == [("STATISTICS_VALID_PERCENT", 0.0)]


def test_unknown_kernels_and_types(spark):
    with pytest.raises(ValueError):
        resample.overview(spark.createDataFrame([], "band int, r int, c int, v int"), "sinc", 1, 1)
    with pytest.raises(ValueError):
        tiles.from_array(spark, np.zeros((4, 4), np.complex64))
    with pytest.raises(ValueError):
        tiles.from_array(spark, np.zeros(4, np.uint8))


def test_taps_table_is_complete():
    assert set(TAPS) | {"nearest", "average", "mode", "rms"} == set(HALO)
