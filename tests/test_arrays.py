"""Arrays as sources."""

from types import SimpleNamespace

import numpy as np
import pytest

from tessella.operators import tiles
from tessella.sources import arrays
from tessella.sources.reader import pages_of, read_cog
from tessella.sources.tiff import GEO_KEYS, NODATA, PIXEL_SCALE


class Labelled:
    """What a labelled array looks like from outside."""

    def __init__(self, data, nodata=None, crs="EPSG:4326"):
        self.data = data
        self.rio = SimpleNamespace(transform=lambda: (0.5, 0, 100, 0, -0.5, 50, 0, 0, 1), crs=crs, nodata=nodata)

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.data, dtype)


def test_labelled_arrays_know_their_place(spark, tmp_path):
    path = str(tmp_path / "x.tif")
    data = np.arange(600, dtype=np.int16).reshape(20, 30)
    assert arrays.write_array(spark, Labelled(data, nodata=7), store=path, options={"resampling": "average", "blocksize": 16}) == path
    tags = pages_of(path)[0][0].tags
    assert tags[PIXEL_SCALE] == [0.5, 0.5, 0] and tags[GEO_KEYS][-1] == 4326 and tags[NODATA] == "7"
    arrays.write_array(spark, Labelled(data, nodata=7, crs=None), store=path, options={"resampling": "average", "blocksize": 16, "nodata": 9})
    tags = pages_of(path)[0][0].tags
    assert tags[NODATA] == "9" and GEO_KEYS not in tags


def test_plain_arrays(spark, tmp_path):
    data = np.random.default_rng(0).integers(0, 99, (3, 40, 25)).astype(np.uint8)
    mask = np.zeros((40, 25))
    mask[5:9] = 2
    raw = arrays.write_array(spark, data.tolist(), mask, options={"resampling": "mode", "blocksize": 16})
    assert raw[:2] == b"II"
    (tmp_path / "x.tif").write_bytes(arrays.write_array(spark, data, mask, options={"resampling": "mode", "blocksize": 16}))
    found = tiles.to_pixels(read_cog(spark, str(tmp_path / "x.tif"))).collect()
    assert {(r.band, r.r, r.c): r.v for r in found} == {(b + 1, y, x): data[b, y, x] for b in range(3) for y in range(5, 9) for x in range(25)}
    with pytest.raises(ValueError):
        arrays.write_array(spark, data, np.ones((3, 3)), options={"resampling": "mode", "blocksize": 16})


def test_array_files(spark, tmp_path):
    data = np.random.default_rng(0).random((2, 50, 70)).astype(">f4")
    mask = np.random.default_rng(1).integers(0, 2, (50, 70))
    np.save(tmp_path / "a.npy", data)
    np.save(tmp_path / "m.npy", mask)
    raster = arrays.from_npy(spark, str(tmp_path / "a.npy"), str(tmp_path / "m.npy"), 16)
    assert (raster.bands, raster.height, raster.width, raster.dtype, raster.has_mask) == (2, 50, 70, "float32", True)
    direct = tiles.from_array(spark, data, mask, 16)
    key = lambda r: (r.tile_row, r.tile_col)
    assert sorted(raster.tiles.collect(), key=key) == sorted(direct.tiles.collect(), key=key)
    with pytest.raises(ValueError):
        arrays.from_npy(spark, str(tmp_path / "a.npy"), str(tmp_path / "a.npy"))


class Chunked:
    """An array file that tells its chunks and is read a window at a time."""

    def __init__(self, path, chunks):
        self.path, self.chunks = path, chunks
        whole = np.load(path, mmap_mode="r")
        self.shape, self.dtype = whole.shape, whole.dtype

    def __getitem__(self, at):
        return np.array(np.load(self.path, mmap_mode="r")[at])

    def __array__(self, *_, **__):
        raise AssertionError("the whole array was asked for")


@pytest.mark.parametrize("chunks", [((2,), (32, 32, 16, 9), (48, 48, 4)), (2, 32, 48)])
def test_chunked_arrays_are_read_by_tasks(spark, tmp_path, chunks):
    data = np.random.default_rng(3).integers(0, 255, (2, 89, 100)).astype(np.uint8)
    mask = np.random.default_rng(4).random((89, 100)) < 0.5
    np.save(tmp_path / "data.npy", data)
    np.save(tmp_path / "mask.npy", mask)
    arr, lazy = Chunked(str(tmp_path / "data.npy"), chunks), Chunked(str(tmp_path / "mask.npy"), chunks[1:])
    options = {"resampling": "average", "blocksize": 16}
    for of_data, of_mask in ((None, None), (mask, lazy), (mask, mask)):
        assert arrays.write_array(spark, arr, of_mask, options=options) == arrays.write_array(spark, data, of_data, options=options)


def test_chunks_that_make_no_whole_tiles(spark):
    fetch = lambda *_: None
    for chunks in (((1, 1), (16,), (16,)), ((20, 20), (16,)), ((16,), (16, 24, 8)), ((16,),)):
        with pytest.raises(ValueError):
            arrays.from_chunks(spark, fetch, chunks, "uint8", 16)
    # A thin last chunk joins the one before it.
    made = arrays.from_chunks(spark, lambda t, b, l, r: np.full((b - t, r - l), b - t, np.uint8), ((16, 16, 12), (16,)), "uint8", 16)
    rows = {r.tile_row: (r.height, r.payload[0]) for r in made.tiles.collect()}
    assert rows == {0: (16, 16), 1: (16, 28), 2: (12, 28)}
