"""Written files: read back by the own reader and by an independent one, and what is left after failures."""

import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.options import OptionError
from tessella.operators import tiles
from tessella.operators.layout import part_size
from tessella.plans.cog import write_cog
from tessella.sources import codecs, multipart
from tessella.sources.reader import pages_of, read_cog, read_tiles
from tessella.sources.tiff import COLORMAP, GEO_KEYS, METADATA, NODATA, PIXEL_SCALE, RPC, TIEPOINTS, TRANSFORMATION
from tests import fake_s3


def image(spark, path, level=0):
    """A level as an array and its mask."""
    raster = read_cog(spark, path, level)
    kind = "f" if np.dtype(raster.dtype).kind == "f" else "i"
    data, valid = np.zeros((raster.bands, raster.height, raster.width), raster.dtype), np.zeros((raster.bands, raster.height, raster.width), bool)
    for r in tiles.to_pixels(raster, only_valid=False).collect():
        data[r.band - 1, r.r, r.c] = r.v if kind == "f" else int(r.v)
        valid[r.band - 1, r.r, r.c] = r.valid
    return data, valid


@pytest.mark.parametrize(("compress", "predictor", "dtype"), [("none", 1, "uint8"), ("deflate", 2, "int16"), ("zstd", 3, "float32"), ("lzma", 1, "float64"), ("lzw", 2, "uint16"), ("deflate", 3, "float64"), ("zstd", 2, "uint64")])
def test_codecs_and_types(spark, tmp_path, compress, predictor, dtype):
    data = (np.random.default_rng(3).random((2, 37, 50)) * 200).astype(dtype)
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, data, blocksize=16), path, {"overview_resampling": "nearest", "blocksize": 16, "compress": compress, "predictor": predictor}, part_bytes=3000)
    found, _ = image(spark, path)
    assert (found == data).all()
    half, _ = image(spark, path, 1)
    assert (half == data[:, 0:36:2, 0:50:2]).all()
    assert len(pages_of(path)) == 3


@pytest.mark.parametrize("shape", [(1, 1), (1, 40), (40, 1), (15, 15), (16, 16), (17, 17), (33, 64)])
@pytest.mark.parametrize("ghost", [True, False])
def test_sizes_with_masks(spark, tmp_path, shape, ghost):
    rng = np.random.default_rng(4)
    data, mask = rng.integers(0, 255, shape).astype(np.uint8), rng.random(shape) < 0.5
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, data, mask, 16), path, {"overview_resampling": "average", "blocksize": 16, "cog_ghost_data": ghost}, part_bytes=500)
    found, valid = image(spark, path)
    assert (valid[0] == mask).all()
    assert (found[0][mask] == data[mask]).all()


def test_bytes_equal_the_file(spark, tmp_path):
    data = np.arange(40 * 50, dtype=np.uint16).reshape(40, 50)
    raster = tiles.from_array(spark, data, blocksize=16)
    options = {"overview_resampling": "cubic", "blocksize": 16}
    made = write_cog(raster, None, options)
    write_cog(raster, str(tmp_path / "x.tif"), options, part_bytes=700)
    assert (tmp_path / "x.tif").read_bytes() == made


def test_structure(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 9, (100, 90)).astype(np.uint8)
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, data, np.ones((100, 90)), 16), path, {"overview_resampling": "mode", "blocksize": 16})
    raw = (tmp_path / "x.tif").read_bytes()
    assert raw[:4] == b"II\x2b\0"
    assert raw[16:].startswith(b"GDAL_STRUCTURAL_METADATA_SIZE=")
    told = raw[59 : 59 + int(raw[46:52])]
    assert told.startswith(b"LAYOUT=IFDS_BEFORE_DATA") and told.endswith(b"MASK_INTERLEAVED_WITH_IMAGERY=YES\n")
    spans, first = [], []
    for page, mask in pages_of(path):
        for p in (page, mask):
            at, size, n = p.offsets
            offsets = np.frombuffer(raw[at : at + n * size], f"<u{size}")
            at, size, n = p.counts
            counts = np.frombuffer(raw[at : at + n * size], f"<u{size}")
            for o, c in zip(offsets.tolist(), counts.tolist(), strict=True):
                if c:
                    assert struct.unpack("<I", raw[o - 4 : o])[0] == c
                    assert raw[o + c : o + c + 4] == raw[o + c - 4 : o + c]
                    spans.append((o - 4, o + c + 4))
        first.append(min(o for o in np.frombuffer(raw[page.offsets[0] : page.offsets[0] + 8], "<u8").tolist()))
    spans.sort()
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert spans[-1][1] == len(raw)
    assert first == sorted(first, reverse=True)  # the smallest level comes first


def test_sparse(spark, tmp_path):
    data = np.zeros((64, 64), np.int16)
    data[20, 20] = 5
    sizes = {}
    for sparse in (True, False):
        path = str(tmp_path / f"{sparse}.tif")
        write_cog(tiles.from_array(spark, data, blocksize=16, nodata=0), path, {"overview_resampling": "nearest", "blocksize": 16, "sparse_ok": sparse, "compress": "none"})
        sizes[sparse] = os.path.getsize(path)
        assert read_cog(spark, path).tiles.count() == (1 if sparse else 16)
        assert [(r.r, r.c, r.v) for r in tiles.to_pixels(read_cog(spark, path)).collect()] == [(20, 20, 5)]
    assert sizes[True] < sizes[False]
    path = str(tmp_path / "empty.tif")
    write_cog(tiles.from_array(spark, np.zeros((64, 64), np.int16), blocksize=16, nodata=0), path, {"overview_resampling": "nearest", "blocksize": 16})
    assert read_cog(spark, path).tiles.count() == 0
    path = str(tmp_path / "zeros.tif")  # without nodata, zeros are pixels
    write_cog(tiles.from_array(spark, np.zeros((64, 64), np.int16), blocksize=16), path, {"overview_resampling": "nearest", "blocksize": 16})
    assert tiles.to_pixels(read_cog(spark, path)).count() == 64 * 64


def test_metadata(spark, tmp_path):
    path = str(tmp_path / "x.tif")
    data = np.random.default_rng(2).integers(1, 9, (2, 20, 20)).astype(np.int32)
    options = {
        "overview_resampling": "rms", "blocksize": 16, "nodata": -5, "statistics": True, "crs": "EPSG:32755", "transform": (10, 0, 5e5, 0, -10, 6e6),
        "update_tags": {0: {"about": "a < b & c"}, 1: {"x": 1}}, "descriptions": ["one", "two"], "offsets": [0.5, 1], "scales": [2, 3], "units": ["m", None], "colorinterp": ["gray", "alpha"],
    }
    write_cog(tiles.from_array(spark, data, blocksize=16), path, options)
    tags = pages_of(path)[0][0].tags
    xml = tags[METADATA]
    for part in ('<Item name="about">a &lt; b &amp; c</Item>', '<Item name="x" sample="0">1</Item>', 'name="STATISTICS_MEAN" sample="1"', 'role="description">two<', 'name="UNITTYPE" sample="0" role="unittype">m<', 'role="colorinterp">alpha<', "STATISTICS_VALID_PERCENT"):
        assert part in xml
    assert tags[NODATA] == "-5"
    assert tags[PIXEL_SCALE] == [10.0, 10.0, 0.0] and tags[TIEPOINTS][3:5] == [5e5, 6e6]
    keys = tags[GEO_KEYS]
    assert keys[:4] == [1, 1, 1, 3] and keys[-1] == 32755
    assert METADATA not in pages_of(path)[1][0].tags if len(pages_of(path)) > 1 else True


def test_other_georeferences(spark, tmp_path):
    data = np.zeros((16, 16), np.uint8)
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, data, blocksize=16), path, {"resampling": "mode", "blocksize": 16, "transform": (1, 2, 3, 4, 5, 6), "crs": "my own", "geotiff_version": 1.0})
    tags = pages_of(path)[0][0].tags
    assert tags[TRANSFORMATION][:8] == [1, 2, 0, 3, 4, 5, 0, 6] and tags[GEO_KEYS][:3] == [1, 1, 0]
    rpc = {"line_off": 7, **{k: list(range(20)) for k in ("line_num_coeff", "line_den_coeff", "samp_num_coeff", "samp_den_coeff")}}
    write_cog(tiles.from_array(spark, data, blocksize=16), path, {"resampling": "mode", "blocksize": 16, "gcps": [(0, 0, 10, 20), (15, 0, 11, 20, 3)], "rpcs": rpc})
    tags = pages_of(path)[0][0].tags
    assert tags[TIEPOINTS] == [0, 0, 0, 10, 20, 0, 15, 0, 0, 11, 20, 3]
    assert len(tags[RPC]) == 92 and tags[RPC][2] == 7


def test_colormap(spark, tmp_path):
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, np.ones((16, 16), np.uint8), blocksize=16), path, {"resampling": "nearest", "blocksize": 16, "write_colormap": {1: (255, 0, 4, 9)}})
    table = pages_of(path)[0][0].tags[COLORMAP]
    assert len(table) == 768 and (table[1], table[257], table[513]) == (65535, 0, 4 * 257)
    with pytest.raises(ValueError):
        write_cog(tiles.from_array(spark, np.ones((16, 16), np.float32), blocksize=16), None, {"resampling": "nearest", "blocksize": 16, "write_colormap": {1: (1, 1, 1)}})


def test_reader_prunes_tiles(spark, tmp_path):
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, np.arange(80 * 80, dtype=np.int32).reshape(80, 80), blocksize=16), path, {"resampling": "nearest", "blocksize": 16})
    found = read_tiles(spark, path, partition_bytes=1 << 10).where("level = 0 AND tile_row = 2 AND tile_col >= 3")
    assert found.rdd.getNumPartitions() == 2
    assert sorted((r.tile_row, r.tile_col) for r in found.select("tile_row", "tile_col").collect()) == [(2, 3), (2, 4)]
    window = tiles.to_pixels(read_cog(spark, path, 0, (33, 50, 40, 70))).where("r = 33 AND c = 50").first()
    assert window.v == 33 * 80 + 50
    assert read_tiles(spark, path).where("level = 9").count() == 0


def test_independent_reader(spark, tmp_path):
    """The JDK's own TIFF reader, which knows the classic form."""
    from tessella.functions.options import CogOptions
    from tessella.plans.cog import planned

    data = np.random.default_rng(9).integers(0, 255, (50, 70)).astype(np.uint8)
    for codec in ("none", "deflate", "lzw"):
        own = CogOptions(kernel="nearest", blocksize=16, compress=codec, overview_compress=codec, ghost=False, bigtiff=False)
        plan = planned(tiles.from_array(spark, data, blocksize=16), own)
        out = bytearray(plan.total)
        for r in plan.parts(1000).orderBy("part_no", "layer", "at").collect():
            start = (r.part_no - 1) * 1000 + r.at
            out[start : start + len(r.data)] = r.data
        path = tmp_path / f"{codec}.tif"
        path.write_bytes(out)
        jvm = spark.sparkContext._jvm
        picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(path)))
        assert picture is not None
        got = [[picture.getRaster().getSample(x, y, 0) for x in range(0, 70, 3)] for y in range(0, 50, 3)]
        assert got == data[::3, ::3].tolist()


def test_failure_leaves_nothing(spark, tmp_path):
    path = tmp_path / "x.tif"
    raster = tiles.from_array(spark, np.ones((40, 40), np.uint8), blocksize=16)
    from tessella.plans.cog import planned
    from tessella.functions.options import CogOptions
    from tessella.sources.sink import write_parts

    plan = planned(raster, CogOptions(kernel="mode", blocksize=16))
    broken = plan.parts(500).withColumn("data", F.when(F.col("part_no") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        write_parts(broken, multipart.LocalStore(str(path)), 500, plan.total)
    assert os.listdir(tmp_path) == []


def test_s3_calls(spark, tmp_path):
    fake_s3.reset(str(tmp_path))
    data = np.random.default_rng(7).integers(0, 255, (3, 60, 60)).astype(np.uint8)
    options = {"overview_resampling": "average", "blocksize": 16}
    raster = tiles.from_array(spark, data, blocksize=16)
    where = write_cog(raster, "s3://box/a/b.tif", options, {"client": "tests.fake_s3:client", "root": str(tmp_path)}, part_bytes=2000)
    assert where == "s3://box/a/b.tif"
    assert (tmp_path / "done" / "box" / "a" / "b.tif").read_bytes() == write_cog(raster, None, options)
    assert "create box" in fake_s3.log(str(tmp_path))[0]
    url = multipart.presigned_url("s3://box/a/b.tif", storage_options={"client": "tests.fake_s3:client", "root": str(tmp_path)})
    assert url == f"https://box/a/b.tif?for={8 * 3600}"
    with pytest.raises(ValueError):
        multipart.resolved("gs://x/y")
    with pytest.raises(ValueError):
        multipart.resolved("s3://x/y")
    with pytest.raises(ValueError):
        multipart.presigned_url(str(tmp_path / "x"))


def test_s3_failure_aborts(spark, tmp_path):
    fake_s3.reset(str(tmp_path))
    raster = tiles.from_array(spark, np.random.default_rng(7).integers(0, 255, (60, 60)).astype(np.uint8), blocksize=16)
    with pytest.raises(Exception):
        write_cog(raster, "s3://box/bad.tif", {"resampling": "mode", "blocksize": 16}, {"client": "tests.fake_s3:client", "root": str(tmp_path), "fail_part": 2}, part_bytes=1000)
    time.sleep(0.1)
    assert any(line.startswith("abort") for line in fake_s3.log(str(tmp_path)))
    assert not (tmp_path / "done").exists()


def test_session(tmp_path):
    none = multipart.MultipartSession(None)
    assert none.upload(1, b"x") is None and none.complete([]) is None
    session = multipart.MultipartSession(str(tmp_path / "f"))
    receipts = [session.upload(1, [b"ab", [b"c"]]), session.upload(None, b"z"), session.upload(2, b""), session.upload(2, b"de")]
    assert [r is None for r in receipts] == [False, True, True, False]
    session.complete([receipts[3], [receipts[0], None]])
    assert (tmp_path / "f").read_bytes() == b"abcde"
    gone = multipart.MultipartSession(str(tmp_path / "g"))
    gone.upload(1, b"x")
    gone.abort()
    assert not (tmp_path / "g").exists() and len(os.listdir(tmp_path)) == 1


def test_part_size():
    assert part_size(10) == 5 << 20
    assert part_size(10**12) == 10**8
    with pytest.raises(ValueError):
        part_size(6 << 40)


def test_masks_apart_and_wrong_sizes(spark):
    raster = tiles.from_array(spark, np.ones((20, 20), np.uint8), blocksize=16)
    with pytest.raises(ValueError):
        write_cog(raster, None, {"resampling": "mode", "blocksize": 16}, mask=np.ones((3, 3)))
    with pytest.raises(ValueError):
        write_cog(raster, None, {"resampling": "mode", "blocksize": 32})
    with pytest.raises(OptionError):
        write_cog(raster, None, {"blocksize": 16})


def test_mask_as_an_array(spark, tmp_path):
    mask = np.zeros((20, 20))
    mask[3, 4] = 1
    path = str(tmp_path / "x.tif")
    write_cog(tiles.from_array(spark, np.ones((20, 20), np.uint8), blocksize=16), path, {"resampling": "mode", "blocksize": 16}, mask=mask)
    assert [(r.r, r.c) for r in tiles.to_pixels(read_cog(spark, path)).collect()] == [(3, 4)]


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 3000, bytes(range(256)) * 40])
def test_lzw(data):
    assert codecs.decoded(codecs.encoded(data, "lzw"), "lzw", len(data)) == data


@pytest.mark.parametrize(("predictor", "dtype"), [(1, "uint8"), (2, "int16"), (2, "uint32"), (3, "float32"), (3, "float64")])
def test_predictors(predictor, dtype):
    block = (np.random.default_rng(0).random((16, 16, 3)) * 1000).astype(np.dtype(dtype).newbyteorder("<"))
    assert (codecs.summed(codecs.differenced(block, predictor), predictor, block.shape, block.dtype) == block).all()
