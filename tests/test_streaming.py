"""Patches: only ancestors are made again, and the result is that of making everything."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import tiles
from tessella.streaming.patches import needed, patch_stream, patched, touched


def whole(raster):
    return sorted((r.tile_row, r.tile_col, bytes(r.payload)) for r in raster.tiles.collect())


@pytest.mark.parametrize("kernel", ["average", "nearest", "cubic", "lanczos"])
@pytest.mark.parametrize("place", [(0, 0), (2, 3), (6, 5)])
def test_patched_levels(spark, kernel, place):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 99, (100, 90)).astype(np.int16)
    raster = tiles.from_array(spark, data, blocksize=16)
    changed = data.copy()
    y, x = place[0] * 16, place[1] * 16
    changed[y : y + 16, x : x + 16] = 77
    after = tiles.from_array(spark, changed, blocksize=16)
    patch = replace(after, tiles=after.tiles.where((F.col("tile_row") == place[0]) & (F.col("tile_col") == place[1])))
    base, above = patched(raster, tiles.overview(raster, kernel), patch, kernel)
    assert whole(base) == whole(after)
    assert whole(above) == whole(tiles.overview(after, kernel))


def test_little_is_made_again(spark):
    raster = tiles.from_array(spark, np.zeros((512, 512), np.uint8), blocksize=16)
    changed = spark.createDataFrame([(10, 10)], "tile_row int, tile_col int")
    assert touched(changed, raster, "average").count() == 1
    parents = touched(changed, raster, "lanczos")
    assert parents.count() == 4
    assert needed(parents, raster, "lanczos").count() == 36


def test_stream_of_patches(spark, tmp_path):
    one = tiles.from_array(spark, np.full((32, 32), 1, np.uint8), blocksize=16).tiles
    two = tiles.from_array(spark, np.full((32, 32), 2, np.uint8), blocksize=16).tiles.where("tile_row = 1")
    (tmp_path / "in").mkdir()
    one.withColumn("seq", F.lit(1)).unionByName(two.withColumn("seq", F.lit(2))).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(one.withColumn("seq", F.lit(1)).schema).parquet(str(tmp_path / "in"))

    def apply(latest, number):
        latest.write.mode("overwrite").parquet(str(tmp_path / f"out-{number}"))

    patch_stream(source, apply, str(tmp_path / "checkpoint")).awaitTermination(120)
    found = {(r.tile_row, r.tile_col): set(r.payload) for r in spark.read.parquet(str(tmp_path / "out-0")).collect()}
    assert found == {(0, 0): {1}, (0, 1): {1}, (1, 0): {2}, (1, 1): {2}}
