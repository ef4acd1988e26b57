"""Overviews of half the size over pixels as rows.

pixels hold the valid pixels only (band, r, c, v); so does the result.  The image has height x width
pixels; an odd last row or column belongs to no output pixel (if there are two or more), but tap kernels
still read it.  An output pixel is valid if one of its own 2 x 2 source pixels is.  Taps outside the
image or on invalid pixels drop out and the rest weigh as much more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import halved
from ..functions.kernels import HALO, TAPS, taps
from ..session import written

WHOLE = ("tinyint", "smallint", "int", "bigint")


def _half(name: str) -> Column:
    return F.call_function("div", F.col(name), F.lit(2)).cast("int")


def _owned(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where((F.col("r") < 2 * halved(height)) & (F.col("c") < 2 * halved(width)))


def overview(pixels: DataFrame, kernel: str, height: int, width: int, rounded: bool = False) -> DataFrame:
    """band, r, c, v of the next level; rounded: half away from zero, in the type of the pixels."""
    if kernel not in HALO:
        raise ValueError(f"no kernel {kernel}")
    kind = dict(pixels.dtypes)["v"]
    if kernel == "nearest":
        owned = _owned(pixels, height, width).where("r % 2 = 0 AND c % 2 = 0")
        return owned.select("band", _half("r").alias("r"), _half("c").alias("c"), "v")
    if kernel in TAPS:
        out = _by_taps(pixels, kernel, height, width, kind in WHOLE)
    else:
        cells = _owned(pixels, height, width).select("band", _half("r").alias("r"), _half("c").alias("c"), "v")
        by = cells.groupBy("band", "r", "c")
        if kernel == "average":
            out = by.agg(F.avg("v").alias("v"))
        elif kernel == "rms":
            out = by.agg(F.sqrt(F.avg(F.col("v").cast("double") * F.col("v"))).alias("v"))
        else:
            return by.agg(_mode("v").cast(kind).alias("v"))
    if rounded and kind in WHOLE:
        return out.withColumn("v", F.round("v").cast(kind))
    return out


def _mode(name: str) -> Column:
    """The most frequent of at most four values, the smallest of several."""
    values = F.array_sort(F.collect_list(name))
    counted = F.transform(values, lambda x: F.struct(F.size(F.filter(values, lambda y: y == x)).alias("n"), x.alias("v")))
    best = F.array_max(F.transform(counted, lambda s: s["n"]))
    return F.element_at(F.filter(counted, lambda s: s["n"] == best), 1)["v"]


def _by_taps(pixels: DataFrame, kernel: str, height: int, width: int, whole: bool) -> DataFrame:
    """Columns, then rows: sums of w * v and w pass through both, so the quotient is over all valid taps.

    A pixel reaches only taps of its own parity, which are an array in its row: no join.
    """
    kind = "bigint" if whole else "double"
    def spread(cells: DataFrame, axis: str, length: int, columns: list[Column]) -> DataFrame:
        def some(parity: int) -> Column:
            return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).cast(kind).alias("w")) for k, w in taps(kernel) if k % 2 == parity))

        out = cells.withColumn("tap", F.explode(F.when(F.col(axis) % 2 == 0, some(0)).otherwise(some(1))))
        at = F.col(axis) - F.col("tap.k")
        return out.where((at >= 0) & (at < 2 * halved(length))).select(*columns, F.call_function("div", at, F.lit(2)).cast("int").alias(axis), "tap")

    near = F.col("tap.k").isin(0, 1)
    source = pixels.select("band", "r", "c", F.col("v").cast(kind).alias("v"))
    across = spread(source, "c", width, [F.col("band"), F.col("r"), F.col("v")])
    across = across.groupBy("band", "r", "c").agg(F.sum(F.col("tap.w") * F.col("v")).alias("nv"), F.sum("tap.w").alias("nw"), F.max(near).alias("own"))
    down = spread(across, "r", height, [F.col("band"), F.col("c"), F.col("nv"), F.col("nw"), F.col("own")])
    down = down.groupBy("band", "r", "c").agg(F.sum(F.col("tap.w") * F.col("nv")).alias("nv"), F.sum(F.col("tap.w") * F.col("nw")).alias("nw"), F.max(F.col("own") & near).alias("own"))
    # Negative weights can cancel; a pixel without weight has no value.
    value = F.col("nv").cast("double") / F.nullif(F.col("nw").cast("double"), F.lit(0.0))
    return down.where("own").select("band", "r", "c", value.alias("v")).where("v IS NOT NULL")


def pyramid(pixels: DataFrame, kernel: str, height: int, width: int, levels: int, rounded: bool = True) -> DataFrame:
    """level, band, r, c, v of all levels from 0; each is made from the one before, rounded to the type
    of the pixels if whole.

    Each overview is written to the shared folder as soon as it is planned.  A plan of all levels would
    make every level from the pixels again, since their filters keep Spark from sharing the exchange.
    """
    now = pixels.select("band", "r", "c", "v")
    out = now.select(F.lit(0).alias("level"), "band", "r", "c", "v")
    for level in range(1, levels + 1):
        now = written(overview(now, kernel, halved(height, level - 1), halved(width, level - 1), rounded), f"overview{level}")
        out = out.unionByName(now.select(F.lit(level).alias("level"), "band", "r", "c", "v"))
    return out
